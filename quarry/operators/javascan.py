"""``scan_declarations``: Java source files -> one row per declaration.

A small per-file helper runs inside ``mapInPandas`` (Arrow batches, one
file at a time): it blanks comments and literals, tokenises, and walks the
braces to find type, method, constructor, field and local-variable
declarations. It keeps no AST and resolves no symbols; every metric is then a
DataFrame expression over the rows it emits (``operators.metrics``).

Each file yields one ``kind='file'`` row (with ``parse_ok``) and, when the
file scans cleanly, one row per declaration. Unbalanced braces, an
unterminated comment or literal make ``parse_ok`` false and no declaration
rows are emitted for that file (the reference skips unparsable files).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECL_SCHEMA = (
    "project_id int, file string, parse_ok boolean, kind string, depth int, "
    "top_level_member boolean, name string, parent string, modifiers array<string>, "
    "n_type_params int, n_params int, extends array<string>, implements array<string>, "
    "body_chars int, begin_line int, end_line int, decl_type string, new_type string, decisions int")

# Java modifiers and the keywords that start a type declaration.
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native",
             "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
TYPE_KEYWORDS = {"class", "interface", "enum", "@interface", "record"}
NOT_A_TYPE = {"return", "throw", "new", "else", "case", "do", "try", "yield", "assert",
              "break", "continue", "if", "for", "while", "switch", "synchronized", "this", "super"}
DECISION_TOKENS = {"if", "for", "while", "case", "catch", "&&", "||", "?"}

_TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|\d[\w.]*|&&|\|\||\S")


class ScanError(Exception):
    pass


def _blank(src: str) -> str:
    """Replace comments and string/char literal contents by spaces (newlines kept)."""
    out, i, n = [], 0, len(src)
    while i < n:
        c = src[i]
        if c == "/" and src.startswith("//", i):
            j = src.find("\n", i)
            j = n if j < 0 else j
            out.append(" " * (j - i))
            i = j
        elif c == "/" and src.startswith("/*", i):
            j = src.find("*/", i + 2)
            if j < 0:
                raise ScanError("unterminated comment")
            out.append(re.sub(r"[^\n]", " ", src[i:j + 2]))
            i = j + 2
        elif c in "\"'":
            if c == '"' and src.startswith('"""', i):  # text block
                j = src.find('"""', i + 3)
                if j < 0:
                    raise ScanError("unterminated text block")
                out.append('"' + re.sub(r"[^\n]", " ", src[i + 1:j + 2]) + '"')
                i = j + 3
                continue
            j = i + 1
            while j < n and src[j] != c:
                if src[j] == "\n":
                    raise ScanError("unterminated literal")
                j += 2 if src[j] == "\\" else 1
            if j >= n:
                raise ScanError("unterminated literal")
            out.append(c + " " * (j - i - 1) + c)
            i = j + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def _tokens(clean: str) -> list[tuple[str, int, int]]:
    """(text, line, offset) of every token; '@interface' is one token."""
    toks, line, last = [], 1, 0
    for m in _TOKEN.finditer(clean):
        line += clean.count("\n", last, m.start())
        last = m.start()
        toks.append((m.group(), line, m.start()))
    merged = []
    for t in toks:
        if t[0] == "interface" and merged and merged[-1][0] == "@":
            merged[-1] = ("@interface", merged[-1][1], merged[-1][2])
        else:
            merged.append(t)
    return merged


def stmt_start_is_decl(sc: "_Scanner", i: int) -> bool:
    """True when the identifier at i is itself being declared (``Type name(``) - not a call."""
    prev = sc.tok(i - 1)
    return bool(re.match(r"[A-Za-z_$]", prev)) and prev not in NOT_A_TYPE


class _Scanner:
    def __init__(self, clean: str):
        self.clean = clean
        self.t = _tokens(clean)
        self.rows: list[dict] = []

    # -- helpers ----------------------------------------------------------
    def tok(self, i: int) -> str:
        return self.t[i][0] if i < len(self.t) else ""

    def match(self, i: int, open_: str, close: str) -> int:
        """Index of the token closing the bracket at i."""
        depth = 0
        for j in range(i, len(self.t)):
            s = self.t[j][0]
            if s == open_:
                depth += 1
            elif s == close:
                depth -= 1
                if depth == 0:
                    return j
        raise ScanError(f"unbalanced {open_}")

    def angle_end(self, i: int) -> int:
        depth = 0
        for j in range(i, len(self.t)):
            s = self.t[j][0]
            if s == "<":
                depth += 1
            elif s == ">":
                depth -= 1
                if depth == 0:
                    return j
            elif s in ";{}":
                break
        raise ScanError("unbalanced <")

    def count_items(self, i: int, j: int) -> int:
        """Top-level comma-separated items between brackets at i and j."""
        if j == i + 1:
            return 0
        depth, n = 0, 1
        for k in range(i + 1, j):
            s = self.t[k][0]
            if s in "(<[{":
                depth += 1
            elif s in ")>]}":
                depth -= 1
            elif s == "," and depth == 0:
                n += 1
        return n

    def skip_annotation(self, i: int) -> int:
        i += 1
        while self.tok(i + 1) == "." and self.tok(i + 2):
            i += 2
        i += 1
        if self.tok(i) == "(":
            i = self.match(i, "(", ")") + 1
        return i

    def type_names(self, i: int, stop: set[str]) -> tuple[list[str], int]:
        """Simple names of a comma-separated type list starting at i."""
        names, cur = [], None
        while i < len(self.t) and self.tok(i) not in stop:
            s = self.tok(i)
            if s == "<":
                i = self.angle_end(i) + 1
                continue
            if s == ",":
                names.append(cur)
                cur = None
            elif s == "@":
                i = self.skip_annotation(i)
                continue
            elif s != ".":
                cur = s
            i += 1
        if cur is not None:
            names.append(cur)
        return names, i

    def emit(self, **kw) -> None:
        row = dict(kind=None, depth=0, top_level_member=False, name=None, parent=None,
                   modifiers=[], n_type_params=0, n_params=0, extends=[], implements=[],
                   body_chars=None, begin_line=None, end_line=None, decl_type=None,
                   new_type=None, decisions=None)
        row.update(kw)
        self.rows.append(row)

    def body_stats(self, i: int, j: int) -> tuple[int, int]:
        """(non-space chars including braces, decision tokens) of the block i..j."""
        a, b = self.t[i][2], self.t[j][2]
        chars = len(re.sub(r"\s", "", self.clean[a:b + 1]))
        dec = sum(1 for k in range(i, j) if self.t[k][0] in DECISION_TOKENS)
        return chars, dec

    # -- declarations -----------------------------------------------------
    def type_decl(self, i: int, mods: list[str], depth: int, parent: str | None,
                  top_member: bool, begin: int) -> int:
        kw = self.tok(i)
        kind = {"@interface": "annotation"}.get(kw, kw)  # records keep kind "record" (not a class)
        name = self.tok(i + 1)
        i += 2
        n_tp = 0
        if self.tok(i) == "<":
            e = self.angle_end(i)
            n_tp = self.count_items(i, e)
            i = e + 1
        if kw == "record" and self.tok(i) == "(":
            i = self.match(i, "(", ")") + 1
        ext, imp = [], []
        while self.tok(i) in ("extends", "implements", "permits"):
            which = self.tok(i)
            names, i = self.type_names(i + 1, {"extends", "implements", "permits", "{"})
            if which == "extends":
                ext += names
            elif which == "implements":
                imp += names
        if self.tok(i) != "{":
            raise ScanError("type body expected")
        end = self.match(i, "{", "}")
        self.emit(kind=kind, depth=depth, top_level_member=top_member, name=name, parent=parent,
                  modifiers=mods, n_type_params=n_tp, extends=ext, implements=imp,
                  begin_line=begin, end_line=self.t[end][1])
        self.type_body(i + 1, end, depth, name, enum=(kind == "enum"), annotation=(kind == "annotation"))
        return end + 1

    def type_body(self, i: int, end: int, depth: int, name: str | None, enum: bool = False,
                  annotation: bool = False) -> None:
        """Members of a type body (tokens i..end-1). Members of a file-level type
        (depth 0) are top-level members."""
        if enum:
            while i < end and self.tok(i) not in (";",):
                s = self.tok(i)
                if s == "(":
                    i = self.match(i, "(", ")") + 1
                elif s == "{":
                    e = self.match(i, "{", "}")
                    self.type_body(i + 1, e, depth + 1, None)
                    i = e + 1
                elif s == "@":
                    i = self.skip_annotation(i)
                else:
                    i += 1
            i += 1
        top = depth == 0
        while i < end:
            s = self.tok(i)
            if s == ";":
                i += 1
                continue
            begin = self.t[i][1]
            mods = []
            while True:
                s = self.tok(i)
                if s in MODIFIERS and self.tok(i + 1) not in (":",):
                    mods.append(s)
                    i += 1
                elif s == "@" and self.tok(i + 1) != "interface":
                    i = self.skip_annotation(i)
                else:
                    break
            s = self.tok(i)
            if s in TYPE_KEYWORDS:
                i = self.type_decl(i, mods, depth + 1, name, top, begin)
                continue
            if s == "{":  # initializer block
                e = self.match(i, "{", "}")
                self.code_block(i + 1, e, depth)
                i = e + 1
                continue
            i = self.member(i, end, mods, depth, name, top, begin, annotation)

    def member(self, i: int, end: int, mods: list[str], depth: int, parent: str | None,
               top: bool, begin: int, annotation: bool) -> int:
        n_tp = 0
        if self.tok(i) == "<":
            e = self.angle_end(i)
            n_tp = self.count_items(i, e)
            i = e + 1
        start = i
        while i < end:
            s = self.tok(i)
            if s == "<":
                i = self.angle_end(i) + 1
                continue
            if s == "(" and i > start and re.match(r"[A-Za-z_$]", self.tok(i - 1)):
                name = self.tok(i - 1)
                is_ctor = (i - 1 == start)
                close = self.match(i, "(", ")")
                n_params = self.count_items(i, close)
                j = close + 1
                while j < end and self.tok(j) not in ("{", ";"):
                    j += 1
                kind = "ctor" if is_ctor else ("annotation_member" if annotation else "method")
                if self.tok(j) == "{":
                    e = self.match(j, "{", "}")
                    chars, dec = self.body_stats(j, e)
                    self.emit(kind=kind, depth=depth, top_level_member=top, name=name, parent=parent,
                              modifiers=mods, n_type_params=n_tp, n_params=n_params, body_chars=chars,
                              begin_line=begin, end_line=self.t[e][1], decisions=dec)
                    self.code_block(j + 1, e, depth, method=(name, n_params, parent))
                    return e + 1
                self.emit(kind=kind, depth=depth, top_level_member=top, name=name, parent=parent,
                          modifiers=mods, n_type_params=n_tp, n_params=n_params,
                          begin_line=begin, end_line=self.t[min(j, len(self.t) - 1)][1], decisions=0)
                return j + 1
            if s in ("=", ";", ","):
                decl = "".join(x[0] for x in self.t[start:i - 1])
                j = self.skip_initializer(i, end, depth)
                self.emit(kind="field", depth=depth, top_level_member=top, name=self.tok(i - 1),
                          parent=parent, modifiers=mods, begin_line=begin,
                          end_line=self.t[min(j, len(self.t) - 1)][1], decl_type=decl)
                return j + 1
            i += 1
        return end

    def skip_initializer(self, i: int, end: int, depth: int) -> int:
        """Index of the ';' ending a field declaration; anonymous class bodies inside are scanned."""
        while i < end and self.tok(i) != ";":
            s = self.tok(i)
            if s == "(":
                i = self.match(i, "(", ")") + 1
                if self.tok(i) == "{" and self._after_new_call(i):
                    e = self.match(i, "{", "}")
                    self.type_body(i + 1, e, depth + 1, None)
                    i = e + 1
                continue
            if s == "{":
                e = self.match(i, "{", "}")
                self.code_block(i + 1, e, depth)
                i = e + 1
                continue
            i += 1
        return i

    def _after_new_call(self, brace: int) -> bool:
        """True when the '{' at ``brace`` follows ``new Type(...)``."""
        depth = 0
        for k in range(brace - 1, -1, -1):
            s = self.tok(k)
            if s == ")":
                depth += 1
            elif s == "(":
                depth -= 1
                if depth == 0:
                    j = k - 1
                    if self.tok(j) == ">":
                        while j > 0 and self.tok(j) != "<":
                            j -= 1
                        j -= 1
                    while j >= 2 and self.tok(j - 1) == ".":
                        j -= 2
                    return self.tok(j - 1) == "new"
        return False

    # -- code -------------------------------------------------------------
    def code_block(self, i: int, end: int, depth: int, method: tuple | None = None) -> None:
        """Statements of a block: local types, local variables with ``new``, anonymous
        classes, and (inside a method) unscoped calls to a method of the same name and arity."""
        stmt_start = True
        while i < end:
            s = self.tok(i)
            if s == "{":
                e = self.match(i, "{", "}")
                if i > 0 and self.tok(i - 1) == ")" and self._after_new_call(i):
                    self.type_body(i + 1, e, depth + 1, None)
                else:
                    self.code_block(i + 1, e, depth, method)
                i, stmt_start = e + 1, True
                continue
            if method is not None and s == method[0] and self.tok(i + 1) == "(" \
                    and self.tok(i - 1) not in (".", "new") and not stmt_start_is_decl(self, i):
                close = self.match(i + 1, "(", ")")
                n_args = self.count_items(i + 1, close)
                if n_args >= 1 and n_args == method[1]:
                    self.emit(kind="selfcall", name=s, parent=method[2], n_params=n_args,
                              begin_line=self.t[i][1], end_line=self.t[close][1])
            if stmt_start:
                j = i
                mods = []
                while self.tok(j) in ("final", "abstract", "static") or self.tok(j) == "@":
                    if self.tok(j) == "@":
                        j = self.skip_annotation(j)
                    else:
                        mods.append(self.tok(j))
                        j += 1
                if self.tok(j) in ("class", "interface", "enum", "record") and \
                        re.match(r"[A-Za-z_$]", self.tok(j + 1)):
                    i = self.type_decl(j, mods, depth + 1, None, False, self.t[j][1])
                    continue
                j2 = self.local_var(j, end)
                if j2 is not None:
                    i = j2
                    stmt_start = False
                    continue
            stmt_start = s in (";", "}") or (s == "(" and self.tok(i - 1) == "for")
            i += 1

    def local_var(self, i: int, end: int) -> int | None:
        """A local declaration ``Type a = new X(...)...`` starting at i: emit it,
        return the index after its declarators' first token; else None."""
        s = self.tok(i)
        if not re.match(r"[A-Za-z_$]", s) or s in NOT_A_TYPE or s in MODIFIERS:
            return None
        j = i + 1
        while self.tok(j) == "." and re.match(r"[A-Za-z_$]", self.tok(j + 1)):
            j += 2
        if self.tok(j) == "<":
            try:
                j = self.angle_end(j) + 1
            except ScanError:
                return None
        while self.tok(j) == "[" and self.tok(j + 1) == "]":
            j += 2
        if not re.match(r"[A-Za-z_$]", self.tok(j)) or self.tok(j + 1) not in ("=", ";", ",", ":"):
            return None
        decl_type = "".join(x[0] for x in self.t[i:j])
        decl_type = re.split(r"[<\[]", decl_type)[0]
        # last ``new`` that directly initialises a declarator of this statement
        new_type, k, depth = None, j + 1, 0
        while k < end:
            s = self.tok(k)
            if s in "([{":
                depth += 1
            elif s in ")]}":
                if depth == 0:
                    break
                depth -= 1
            elif s == ";" and depth == 0:
                break
            elif s == "=" and depth == 0 and self.tok(k + 1) == "new":
                parts, m = [], k + 2
                while re.match(r"[A-Za-z_$]", self.tok(m)) and self.tok(m) != "new":
                    parts.append(self.tok(m))
                    if self.tok(m + 1) != ".":
                        break
                    m += 2
                new_type = ".".join(parts) if parts else None
            k += 1
        if new_type is not None:
            self.emit(kind="localvar", decl_type=decl_type, new_type=new_type,
                      begin_line=self.t[i][1], end_line=self.t[min(k, len(self.t) - 1)][1])
        return j + 1

    def scan(self) -> list[dict]:
        i, n = 0, len(self.t)
        while i < n:
            s = self.tok(i)
            if s in ("package", "import"):
                while i < n and self.tok(i) != ";":
                    i += 1
                i += 1
                continue
            if s == ";":
                i += 1
                continue
            begin = self.t[i][1]
            mods = []
            while self.tok(i) in MODIFIERS or (self.tok(i) == "@" and self.tok(i + 1) != "interface"):
                if self.tok(i) == "@":
                    i = self.skip_annotation(i)
                else:
                    mods.append(self.tok(i))
                    i += 1
            if self.tok(i) in TYPE_KEYWORDS:
                i = self.type_decl(i, mods, 0, None, False, begin)
            elif i < n:
                raise ScanError(f"unexpected token {self.tok(i)!r}")
        return self.rows


def scan_source(text: str) -> tuple[bool, list[dict]]:
    """Scan one compilation unit; (parse_ok, declaration rows)."""
    try:
        clean = _blank(text)
        return True, _Scanner(clean).scan()
    except (ScanError, IndexError, RecursionError):
        return False, []


def _scan_batches(batches):
    cols = [f.split()[0] for f in DECL_SCHEMA.split(", ")]
    for pdf in batches:
        out = []
        for pid, path, text in zip(pdf["project_id"], pdf["file"], pdf["text"]):
            ok, rows = scan_source(text or "")
            out.append(dict(project_id=pid, file=path, parse_ok=ok, kind="file", depth=0,
                            top_level_member=False, modifiers=[], extends=[], implements=[],
                            n_type_params=0, n_params=0))
            for r in rows:
                r.update(project_id=pid, file=path, parse_ok=True)
                out.append(r)
        # object columns: pandas may infer pyarrow-backed strings, which the
        # Arrow writer of mapInPandas does not take inside a struct batch
        yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in cols})


def scan_declarations(files: DataFrame, project_col: str = "project_id", file_col: str = "file",
                      text_col: str = "text") -> DataFrame:
    """Declaration rows of every source file (see module doc). One Python pass per file,
    run in parallel over the file partitions; nothing is grouped or collected."""
    src = files.select(F.col(project_col).cast("int").alias("project_id"),
                       F.col(file_col).alias("file"), F.col(text_col).alias("text"))
    return src.mapInPandas(_scan_batches, DECL_SCHEMA)
