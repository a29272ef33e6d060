"""Line dedup: membership of templates and boilerplate in short documents."""

import numpy as np
import pyarrow as pa
import pytest

from httploom.llm import lines


def posts():
    words = "Posted in the forum by anna from rome today".split()
    fields = {5: "bert carl dora emil fred gina".split(), 7: "bonn cork dover essen faro genf".split(), 8: "now soon later often never once".split()}
    changed = [" ".join([*words[:at], new, *words[at + 1 :]]) for at, news in fields.items() for new in news]
    return sorted([" ".join(words), *changed])


def test_templates_do_not_depend_on_batches():
    """One leaf, a border at every place: the same template for each line as without a border."""
    rows = posts()
    leaf = [lines.leaf_of(lines.generalise(r)) for r in rows]
    assert len(set(leaf)) == 1 and len(rows) == 19

    def placed(*sizes):
        batches, at = [], 0
        for size in sizes:
            part = rows[at : at + size]
            columns = [pa.array(leaf[at : at + size], pa.int64()), pa.array(list(map(lines._hash, part)), pa.int64()), pa.array(part, pa.string())]
            batches.append(pa.RecordBatch.from_arrays(columns, ["leaf", "hash", "line"]))
            at += size
        return np.concatenate([np.asarray(b.column(2)) for b in lines._templates(iter(batches), 0.7)]).tolist()

    whole = placed(19)
    assert len(set(whole)) == 1
    for border in range(1, 19):
        assert placed(border, 19 - border) == whole
    assert placed(*[1] * 19) == whole


def page(n):
    return "\n".join(f"{a} page {chr(97 + n)} tells at length of matters {chr(98 + n) * 4} that no other page of these holds" for a in "One Two Three".split())


NOTE = "Share this page with all your friends now"
PASSAGE = "A passage that is longer than the text around it and that many pages of the site show in full to all of their readers again"


@pytest.mark.parametrize("stage", ["op4", "pipeline"])
def test_boilerplate_goes_from_short_documents(spark, stage, tmp_path):
    """A line of many pages goes from a short document that it fills; copies of one text keep it."""
    own = [f"Short {chr(97 + n) * 6} {chr(98 + n) * 5} here" for n in range(12)]
    docs = [(n, f"{page(n)}\n{NOTE}") for n in range(20)] + [(100, f"Ha\n{NOTE}")]
    docs += [(200 + n, f"{PASSAGE}\n{own[n]}") for n in range(12)]
    story = "\n".join(f"{w} part of a story that was copied as it is over and over again" for w in "First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth".split())
    docs += [(300 + n, f"{story}\nseen {'abcdefghijkl'[n]}\n{NOTE}") for n in range(12)]
    docs += [(400 + n, "The same text\nin two lines for all of its holders") for n in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "length(text) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    if stage == "op4":
        from httploom.llm import queries

        found = {r.doc_id: r for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
        texts = {k: r.kept_chars for k, r in found.items()}
        size = len
    else:
        import corpus_pipeline

        found = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        texts, size = {r.doc_id: r.text for r in found.collect()}, lambda t: t
    assert texts[400] == size("The same text\nin two lines for all of its holders")
    assert texts[3] == size(page(3)) and texts[100] == size("Ha")
    assert all(texts[200 + n] == size(own[n]) for n in range(12))
    assert all(texts[300 + n] == size(f"{story}\nseen {'abcdefghijkl'[n]}") for n in range(12))
