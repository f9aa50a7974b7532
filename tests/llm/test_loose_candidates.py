"""Whether a span is proposed does not depend on unrelated characters of its text."""

from driftloom.llm import pii


def test_loose_spans_are_proposed_in_any_text(spark):
    texts = ["jane (at) example (dot) org", "jane[at]example.org", "face:cafe:dead:beef:face:cafe:dead:beef"]
    rows = [(i, t + tail) for i, t in enumerate(texts) for tail in ("", " 7")]
    got = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(any(c.start == 0 and c.end == len(texts[r.key]) for c in r.found) for r in got)
