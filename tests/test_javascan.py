from pyspark.sql import functions as F

from quarry.operators import javascan as J
from quarry.operators import metrics as M

SRC_A = r'''
package demo;
import framework.*;  // framework
/** doc { not a brace */
public class Rocket extends Actor implements Runnable, Comparable<Rocket> {
    private int a, b;                 // one declaration
    public static final String S = "}{\"";
    char c = '{';
    private java.util.List<java.util.Map<String, Integer>> m = new java.util.ArrayList<>();
    int[] arr = {1, 2, 3};
    public Rocket() { }
    public Rocket(int x) { a = x; }
    public void act() { /* comment only */ }
    public <T> T pick(T x, T y) { if (a > b && b > 0) return x; return y; }
    public abstract int area();
    Runnable r = new Runnable() { public void run() { int q = 1; } };
    class Inner extends Rocket { void f() {} }
    enum Mode { ON, OFF { void g() {} }; int z() { return 1; } }
    void local() {
        List<String> xs = new ArrayList<String>();
        Actor p = new Rocket(), q = null;
        Rocket same = new Rocket();
        int[] ys = new int[3];
        for (Actor t = new Bullet(); t != null; ) { }
        class Local {}
        x = new Foo();
    }
}
interface Shape<T> extends Comparable<T>, java.io.Serializable { double area(); }
abstract class Base<K, V> extends World { }
'''


def test_scan_source_rows():
    ok, rows = J.scan_source(SRC_A)
    assert ok
    by = lambda k: [r for r in rows if r["kind"] == k]
    classes = {r["name"]: r for r in by("class")}
    assert set(classes) == {"Rocket", "Inner", "Base", "Local"}
    assert classes["Rocket"]["extends"] == ["Actor"]
    assert classes["Rocket"]["implements"] == ["Runnable", "Comparable"]
    assert classes["Base"]["n_type_params"] == 2 and "abstract" in classes["Base"]["modifiers"]
    iface = by("interface")[0]
    assert iface["name"] == "Shape" and iface["extends"] == ["Comparable", "Serializable"]
    top_fields = [r for r in by("field") if r["top_level_member"]]
    assert len(top_fields) == 6 and sum("private" in r["modifiers"] for r in top_fields) == 2
    top_methods = {r["name"]: r for r in by("method") if r["top_level_member"] and r["parent"] == "Rocket"}
    assert set(top_methods) == {"act", "pick", "area", "local"}
    assert top_methods["act"]["body_chars"] == 2           # comment-only body is empty
    assert top_methods["pick"]["n_type_params"] == 1 and top_methods["pick"]["n_params"] == 2
    assert top_methods["pick"]["decisions"] == 2
    assert "abstract" in top_methods["area"]["modifiers"]
    all_methods = {r["name"] for r in by("method")}
    assert {"run", "f", "g", "z", "area"} <= all_methods    # any depth, incl. anonymous and enum bodies
    ctors = by("ctor")
    assert [r["body_chars"] > 2 for r in ctors] == [False, True]
    locals_ = [(r["decl_type"], r["new_type"]) for r in by("localvar")]
    assert locals_ == [("List", "ArrayList"), ("Actor", "Rocket"), ("Rocket", "Rocket"),
                       ("int", "int"), ("Actor", "Bullet")]


def test_unbalanced_and_empty():
    assert J.scan_source("class A { void f() { }")[0] is False
    assert J.scan_source("class A { String s = \"open; }")[0] is False
    assert J.scan_source("") == (True, [])


def test_metrics_on_spark(spark):
    files = spark.createDataFrame(
        [(7, "7/Rocket.java", SRC_A), (7, "7/Empty.java", "class E { private int x; void f(){} }"),
         (7, "7/Bad.java", "class B {"), (9, "9/Only.java", "class O { }")],
        "project_id int, file string, text string")
    decls = J.scan_declarations(files).cache()
    per = {r["file"]: r for r in M.per_file_metrics(decls).collect()}
    assert per["7/Bad.java"]["parse_ok"] is False and per["7/Bad.java"]["is_empty"] is False
    assert per["7/Empty.java"]["is_empty"] is True and per["7/Empty.java"]["is_empty_all_methods"] is False
    assert per["9/Only.java"]["is_empty"] is True
    r = per["7/Rocket.java"]
    assert (r["method_count_all"], r["method_count"], r["constructor_count"], r["field_count"],
            r["private_field_count"]) == (5, 4, 1, 6, 2)  # Shape.area() is a top-level member too;
    # only act() has an empty body
    ps = {x["project_id"]: x for x in M.project_stats(decls).collect()}
    p = ps[7]
    assert p["class_count"] == 5 and p["interface_count"] == 1  # Rocket, Inner, Local, Base, E
    assert p["abs_class_count"] == 1 and p["abs_method_count"] == 1
    assert p["gen_class_count"] == 1 and p["gen_interface_count"] == 1 and p["gen_method_count"] == 1
    assert p["class_inheritance_count"] == 1            # Inner extends Rocket; Actor/World skipped
    assert p["interface_inheritance_count"] == 4        # Rocket implements 2, Shape extends 2
    assert p["polymorphism_usage_count"] == 3           # List=ArrayList, Actor=Rocket, Actor=Bullet
    counters = M.corpus_counters(M.per_file_metrics(decls)).collect()[0]
    assert tuple(counters) == (4, 3, 2, 1)
    nonempty, total = M.files_per_project(M.per_file_metrics(decls))
    assert {r["project_id"]: r["count"] for r in total.collect()} == {7: 3, 9: 1}
    assert {r["project_id"]: r["count"] for r in nonempty.collect()} == {7: 2}


def test_statistics_table_end_to_end(spark):
    from quarry.operators import statistics_table as ST
    from tests.test_stats import ref_five

    files = spark.createDataFrame(
        [(1, "1/A.java", "class A { int x; void f() { if (a) {} } void g() { b(); } }"),
         (1, "1/B.java", "interface B extends C { void h(); }"),
         (1, "1/E.java", "class E { }"),
         (2, "2/D.java", "abstract class D<T> extends Actor { abstract void k(); int y, z; }")],
        "project_id int, file string, text string")
    decls = J.scan_declarations(files).cache()
    per_file = M.per_file_metrics(decls).cache()
    nonempty, total = M.files_per_project(per_file)
    keep = per_file.filter(~F.col("is_empty")).select("project_id", "file")
    ps = M.project_stats(decls, files=keep)
    sizes = spark.createDataFrame([(1, 4096), (2, 1500)], "project_id int, package_size long")
    psloc = spark.createDataFrame([(1, 12), (2, 5)], "project_id int, sloc int")
    fsloc = spark.createDataFrame([(3,), (4,), (5,)], "sloc int")
    per_method, per_class = M.method_complexity(decls)
    table = ST.statistics_table(ps, per_file.select("project_id", "method_count", "field_count"),
                                nonempty, total, sizes, psloc, fsloc,
                                per_class.select(F.col("complexity").alias("value")),
                                per_method.select(F.col("complexity").alias("value"))).collect()
    rows = {(r["metric_group"], r["ord"]): r for r in table}
    assert len(rows) == 21
    size1 = rows[("Size", 1)]
    assert size1["name"] == "Number of classes per Scenario" and size1["n"] == 2
    assert rows[("Size", 7)]["max"] == 3.0          # project 1 has 3 files in total
    assert rows[("Size", 6)]["max"] == 2.0          # of which 2 are non-empty
    assert rows[("Size", 8)]["max"] == 4.0          # 4096 bytes div 1024
    e = ref_five([3, 4, 5])
    assert (rows[("Size", 10)]["q1"], rows[("Size", 10)]["median"], rows[("Size", 10)]["q3"]) == e[3:6]
    assert rows[("OOP Concepts", 1)]["max"] == 1.0  # one interface in project 1
    assert rows[("Complexity", 2)]["max"] == 2.0    # f() has one decision point


def test_self_call_candidates():
    src = """class R {
        int fact(int n) { return n <= 1 ? 1 : n * fact(n - 1); }
        int fib(int n) { if (n < 2) return n; return fib(n - 1) + this.fib(n - 2); }
        void tick() { tick(); }
        int sum(int a, int b) { return sum(a); }
        void g(int x) { h(x); new Runnable() { public void run() { g(1); } }; }
    }"""
    ok, rows = J.scan_source(src)
    assert ok
    calls = sorted((r["name"], r["parent"]) for r in rows if r["kind"] == "selfcall")
    # fact(n-1); fib(n-1) only (this.fib is scoped); tick() has no argument; sum's arity
    # differs; g(1) sits in run(), whose nearest enclosing method is run, not g
    assert calls == [("fact", "R"), ("fib", "R")]


def test_size_rules_emptiness_and_failed(spark):
    from quarry.operators import rules as R

    long_method = "void big() {\n" + "  x();\n" * 120 + "}\n"
    many = "".join(f"  int f{i};\n" for i in range(16))
    src = "public class Big {\n" + many + long_method + "  void p(int a,int b,int c,int d,int e,int f,int g,int h,int i,int j) {}\n}\n"
    files = spark.createDataFrame([(3, "3/Big.java", src), (4, "4/E.java", "class E {}"), (4, "4/X.java", "class X {")],
                                  "project_id int, file string, text string")
    decls = J.scan_declarations(files).cache()
    viol = R.apply_rules(M.size_metrics_long(decls), R.rules_frame(spark, R.SIZE_RULES))
    got = {r["rule"]: r["n"] for r in R.rule_prevalence(viol, "project_id", alias="n").collect()}
    assert got == {"ExcessiveMethodLength": 1, "ExcessiveParameterList": 1, "TooManyFields": 1, "*any*": 1}
    per = M.per_file_metrics(decls)
    emp = {r["project_id"]: (r["n_files"], r["n_empty"], r["is_empty_project"])
           for r in M.project_emptiness(per).collect()}
    assert emp == {3: (1, 0, False), 4: (2, 1, False)}   # the unparsable file is not empty
    assert [r["file"] for r in M.failed_files(per).collect()] == ["4/X.java"]


def test_record_is_not_a_class():
    ok, rows = J.scan_source("record P(int x, int y) { int sum() { return x + y; } }")
    assert ok
    kinds = sorted(r["kind"] for r in rows)
    assert kinds == ["method", "record"]


def test_more_java_constructs():
    src = r'''
    @Retention(RUNTIME) @interface Tag { String value() default "x"; int[] ids() default {1, 2}; }
    interface Walker { default void walk(int n) { switch (n) { case 1: break; default: stop(); } } void stop(); }
    @SuppressWarnings({"a", "b"})
    public final class Box<K extends Comparable<K>, V> implements Walker {
        private Runnable r = () -> { int inner = 1; };
        static java.util.Comparator<String> C = new java.util.Comparator<>() {
            public int compare(String a, String b) { return a.compareTo(b); }
        };
        public void stop() {}
        public <T extends Number> T[] many(@Deprecated T first, T... rest) { return rest; }
        char q = '\'';
        String s = "\"{}";
        { System.out.println("init"); }
    }
    '''
    ok, rows = J.scan_source(src)
    assert ok
    by = lambda k: sorted(r["name"] for r in rows if r["kind"] == k)
    assert by("annotation") == ["Tag"] and by("annotation_member") == ["ids", "value"]
    assert by("interface") == ["Walker"] and by("class") == ["Box"]
    methods = {r["name"]: r for r in rows if r["kind"] == "method"}
    assert set(methods) == {"walk", "stop", "compare", "many"}
    assert methods["many"]["n_params"] == 2 and methods["many"]["n_type_params"] == 1
    assert "default" in methods["walk"]["modifiers"]
    assert methods["compare"]["top_level_member"] is False         # anonymous class member
    box = [r for r in rows if r["kind"] == "class"][0]
    assert box["n_type_params"] == 2 and box["implements"] == ["Walker"]
    assert sorted(r["name"] for r in rows if r["kind"] == "field") == ["C", "q", "r", "s"]
