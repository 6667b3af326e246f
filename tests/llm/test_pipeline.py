import corpus_pipeline

from evenkeel.llm import chosen_path, decontaminate, line_quality, pieces
from evenkeel.llm.common import table
from evenkeel.session import cut_lineage


def test_stages_one_by_one(spark, sf):
    """Each stage on its own input: rejected documents go, one of each group of copies stays, all else is kept whole."""
    docs = table(spark, sf, "documents")
    texts = {"": {r["doc_id"]: r["text"] for r in docs.collect()}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = cut_lineage(stage(spark, docs, sf))
        assert docs.columns == columns
        texts[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = cut_lineage(corpus_pipeline.STAGES[-1][1](spark, docs, sf)).collect()

    raw, good, lines, single, clean = texts.values()
    model = line_quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    kept = {r["doc_id"] for r in line_quality.judge(table(spark, sf, "documents"), model).where("kept").select("row.doc_id").collect()}
    assert good == {d: t for d, t in raw.items() if d in kept} and 0 < len(good) < len(raw)

    holders, first = {}, {}
    for d, t in sorted(good.items()):
        for k in {"".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")} - {""}:
            holders[k] = holders.get(k, 0) + 1
    assert set(lines) <= set(good) and all(lines[d] == good[d] or max(holders.values()) >= 10 for d in lines)
    assert all(any(k in t.lower() for t in lines.values()) for k, n in holders.items() if n >= 10)

    sets = {d: set(chosen_path.shingles_of(t).tolist()) for d, t in lines.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    assert all(single[d] == lines[d] for d in single)
    assert all(any(alike(d, e) for e in lines if e != d and e < d or e in single) for d in set(lines) - set(single))
    order = sorted(single)
    assert not any(alike(a, b) for i, a in enumerate(order) for b in order[i + 1:])

    items = [(str(r["item_id"]), r["text"]) for r in table(spark, sf, "benchmark").collect()]
    from test_decontaminate import brute

    for d, t in single.items():
        n, hit, _ = brute(t, items)
        assert (d in clean) == (not (hit and 20 * hit >= n))
    encode = pieces.Encoder(pieces.PieceModel(pieces.MODEL))
    assert {r["doc_id"] for r in ids} == set(clean)
    assert all(len(r["ids"]) * 4 == len(encode.encode(clean[r["doc_id"]])) for r in ids)


def test_run_gives_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "ids", "n_ids"} <= set(out.columns) and out.count() > 0
    assert decontaminate.WINDOW == 13 and len(corpus_pipeline.STAGES) == 5
