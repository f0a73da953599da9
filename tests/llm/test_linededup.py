"""Line dedup by windows of three lines."""

from __future__ import annotations

from tests.llm.helpers import documents
from weekcast.llm.linededup import dedup_lines


def plain(rows, size=3):
    """Documents in the order of ids; every later occurrence of a window covers its lines."""
    seen, out = set(), {}
    for i, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = text.split("\n")
        gone = set()
        for at in range(len(lines) - size + 1):
            window = tuple(lines[at : at + size])
            if window in seen:
                gone |= set(range(at, at + size))
            seen.add(window)
        out[i] = ("\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone))
    return out


def check(spark, rows):
    found = {r.doc_id: (r.text, r.removed_lines) for r in dedup_lines(documents(spark, rows)).collect()}
    assert found == plain(rows) | {i: (None, 0) for i, t in rows if t is None}
    return found


def test_against_plain_version(spark):
    passage = "p\nq\nr\ns"
    rows = [
        (3, f"a\n{passage}\nb"), (1, f"{passage}\nc"), (7, passage), (2, "x\nx\nx\nx\nx\nx"), (4, "p\nq"),
        (5, ""), (6, None), (8, f"{passage}\nz\n{passage}"), (9, "\n\n\n\n"), (10, "\n\n"), (11, f"u\n{passage}\nq\nr\ns\nv"),
        (12, "p\nq\nr\n"), (None, passage), (13, "only"),
    ]
    found = check(spark, rows)
    assert found[7] == ("", 4) and found[3] == ("a\nb", 4) and found[2] == ("x", 5)


def test_windows_overlap_and_long_text(spark):
    long = "\n".join(f"line {i % 700}" for i in range(20000))
    found = check(spark, [(1, long), (2, "line 1\nline 2\nline 3\nnew\nline 4\nline 5\nline 6")])
    assert found[2] == ("new", 6) and found[1][0].count("\n") == 699


def test_repeated_rows_and_clashing_columns(spark):
    rows = documents(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (2, "zero\na\nb\nc")],
                     ["1 AS _row", "1 AS _text", "9 AS removed_lines", "1 AS _doc", "2 AS _hash", "3 AS spans", "4 AS at", "5 AS w1", "6 AS first"])
    out = dedup_lines(rows)
    assert out.columns == [*(c for c in rows.columns if c != "removed_lines"), "removed_lines"]
    assert {r.removed_lines for r in out.collect()} == {0, 3}
    assert sorted((r.doc_id, r.text, r.spans) for r in out.collect()) == [
        (1, "a\nb\nc", 3), (1, "a\nb\nc", 3), (2, "", 3), (2, "zero", 3),
    ]
