from cohortry.llm.line_dedup import remove_repeated_lines, with_lines_removed


def brute(docs):
    """docs: (id, text) in order; the text with lines covered by later occurrences cut out."""
    seen, out = set(), []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if not "".join(window).strip():
                continue
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out.append((doc_id, text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return out


def result(df):
    return sorted((r.doc_id, r.text, r.n_removed) for r in df.collect())


def test_windows_overlap_and_merge(rows):
    data = [
        (1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc\nd\ne"), (4, "b\nc"), (5, "z\nz\nz\nz\nz"),
        (6, "\n\n\n\n"), (7, "\n\n\n\n"), (8, "q\na\nb\nc\nr\nc\nd\ne\ns"), (9, ""), (10, "a\nb\nc"),
    ]
    assert result(remove_repeated_lines(rows("doc_id long, text string", *data))) == sorted(brute(data))


def test_edge_rows_and_columns(rows):
    schema = "doc_id long, text string, row int, n_removed string, key int, cuts int"
    docs = rows(
        schema,
        (1, None, 0, "x", 0, 0), (2, "p\nq\nr", 0, "x", 0, 0), (2, "p\nq\nr", 1, "y", 0, 0), (None, "p\nq\nr\ns", 0, "x", 0, 0),
        (3, "long line " * 50_000 + "\np\nq\nr", 0, "x", 0, 0),
    )
    out = remove_repeated_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed_"]
    got = sorted((str(r.doc_id), r.text if r.text is None else r.text[:5], r.n_removed, r.n_removed_) for r in out.collect())
    # a null id comes first, so it keeps the passage
    assert got == [("1", None, "x", 0), ("2", "", "x", 3), ("2", "", "y", 3), ("3", "long ", "x", 3), ("None", "p\nq\nr", "x", 0)]
    assert with_lines_removed(docs, n_chars="key").columns == docs.columns
    assert remove_repeated_lines(docs.where("false")).count() == 0


def test_many_copies(rows):
    data = [(k, "one\ntwo\nthree\nfour\n" + f"own {k}") for k in range(300)]
    got = result(remove_repeated_lines(rows("doc_id long, text string", *data).repartition(7)))
    assert got == sorted(brute(data))


def test_dotted_names_and_many_cuts(rows):
    """A column ``a.b`` is kept as it is, and a text with thousands of cuts is put together in one pass."""
    blocks = [f"x{k}\ny{k}\nz{k}" for k in range(3000)]
    first = "\n".join(blocks)
    second = "\n".join(f"{b}\nown {k}" for k, b in enumerate(blocks))
    docs = rows("doc_id long, text string, `a.b` int, n_chars long", (1, first, 5, 0), (2, second, 6, 0))
    got = {r.doc_id: r for r in remove_repeated_lines(docs).collect()}
    assert got[1].text == first and got[2].text == "\n".join(f"own {k}" for k in range(3000))
    assert (got[2].n_removed, got[2].n_lines, got[2]["a.b"]) == (9000, 12000, 6)
    kept = {r.doc_id: r for r in with_lines_removed(docs, n_chars="n_chars").collect()}
    assert kept[2].n_chars == len(got[2].text) and kept[1]["a.b"] == 5
