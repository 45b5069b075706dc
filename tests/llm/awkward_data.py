"""Rows that every operator has to take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score int, h1 string, row string, bucket int"
P = " ".join(f"w{i}" for i in range(60))


def awkward_rows():
    """Nulls, empties, a very long text, ties, repeated rows, odd white space; and columns whose names clash."""
    long = " ".join(f"x{i % 9973}y{i % 7}" for i in range(60_000))
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "One two THREE", P, P, f"start {P} end", long, "tab\tand nbsp  double\nline.\r\n", "é ß 漢字 😀 “quoted”", f"{P} {P}", "a, b. c, d.", "<|endoftext|> x", "idiot " * 60]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 3}", len(t or ""), "x", 1, "y", "z", 0) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id at all", None, None, None, None, None, None, None, None)]
