"""Line dedup of rows that share a doc_id with different texts."""

from tests.llm.edges import docs, prose
from tritsift.llm import lines


def test_texts_of_one_id_keep_their_own_lines(spark):
    a, c, d, e, same = (prose(n, 8) for n in range(5))
    near = same + "x"
    texts = [(1, a), (7, f"{a}\n{c}"), (7, f"{d}\n{e}"), (8, f"A\n{same}"), (8, f"B\n{same}"), (9, near)]
    kept = sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs(spark, texts)).collect())
    assert kept == sorted([(1, a), (7, c), (7, f"{d}\n{e}"), (8, f"A\n{same}"), (8, "B")])
    got = {tuple(r) for r in lines.dropped_lines(docs(spark, texts)).collect()}
    assert got == {(7, 0, 1, 0, 0), (8, 1, 8, 1, 0), (9, 0, 8, 1, 1)}
