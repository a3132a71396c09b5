"""Writers: CSV/text exports of the reference's outputs, LaTeX table, empty-file routing."""
