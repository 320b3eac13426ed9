"""Licence sentences that are wrapped anywhere, as texts and as comments."""

from tracewell.llm import licenses


def test_wrapped_sentences_pass_the_prefilter(spark):
    assert all(any(w in s for w in licenses.ANCHOR_WORDS) for _, s in licenses.SENTENCES) and not any(" " in w for w in licenses.ANCHOR_WORDS)
    known = dict(licenses.SENTENCES[::-1])
    data = [("All rights\nreserved.", "AllRights"), ("* All rights\n * reserved.", "AllRights"), ("All  rights  reserved.", "AllRights"), ("All rights res'erved", "AllRights")]
    for name, anchor in (("AsIs", "software is provided"), ("NoLiability", "authors or copyright"), ("GplImplied", "implied warranty")):
        data += [(known[name].replace(anchor, anchor.replace(" ", sep)).replace("any warranty", "any" + sep + "warranty"), name) for sep in ("\n", "\n# ", "  ")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {i: got[i].sentence_ids for i in got} == {i: name for i, (_, name) in enumerate(data)}
    assert [got[i].licenses for i in range(4)] == ["AllRightsReserved"] * 4
