"""The pipeline's rows against its stages done plainly, each on what the one before kept."""

import zlib
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from agestrata.llm import components, language, mixing, packing, privacy, simhash


def test_run_is_its_stages_done_plainly(spark, sf_dir, small):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    rows = small.collect()
    model, trees = language.learn(small), privacy.train()
    stay = [(x != language.NONE and s >= 0.35) for x, s in zip(*language.tell([r.text for r in rows], model), strict=True)]
    docs = [r for r, ok in zip(rows, stay, strict=True) if ok]
    assert len(docs) > 0.9 * sum(bool(r.text) for r in rows)  # clean documents are kept
    group = {d: c for d, _, c in brute.simhash_groups([(r.doc_id, r.text) for r in docs], similar=True)}
    docs = [r for r in docs if group[r.doc_id] == r.doc_id]
    clean = []
    for r in docs:
        base = privacy.base_spans(r.text)
        clean.append((r.doc_id, privacy.redacted(r.text, base + privacy.further_spans(r.text, base, trees)), r.lang, r.source, r.n_chars))
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(clean, small.schema)).collect()}
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for d, text, *_ in clean:
        ids, at = np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4"), 0
        for n in packing.lengths(len(ids)):
            want[d, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += copies[d]
            at += n
    got = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == +want


def test_run_on_odd_clashing_and_empty_tables(spark, odd, clashing, empty, tmp_path):
    pieces = []
    for name, df in (("odd", odd), ("clashing", clashing), ("empty", empty)):
        spark.conf.set("spark.sql.caseSensitive", "true")  # only to write and read names that differ in case
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        pieces.append(Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()))
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert pieces[0] and pieces[0] == pieces[1] and not pieces[2]
    assert {d for d, *_ in pieces[0]} <= {1, 5, 6, 7, 9, None}  # no letter in the rest


def test_stages_return_the_columns_of_documents(spark, sf_dir, small):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, small, sf_dir).dtypes == small.dtypes


def test_near_copies_over_three_bits_go(spark):
    rng = np.random.default_rng(3)
    docs = []
    for k in range(20):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        docs.append((k, " ".join(words)))
        for c in range(3):  # each edit changes five shingles: 176 or more of 216 at most are shared
            edited = list(words)
            for at in (40, 80, 120, 160)[: c + 2]:
                edited[at] = f"x{k}-{c}-{at}"
            docs.append((100 + 10 * k + c, " ".join(edited)))
    df = spark.createDataFrame([(d, t, "en", "web", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert got == set(range(20))
    assert len({c for _, _, c in brute.simhash_groups(docs)}) > 20  # three bits leave some


def test_similar_links_join_what_all_pairs_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.text for r in docs.select("text").collect()}
    ids = {r.text: r.th for r in docs.selectExpr("text", "xxhash64(text) as th").collect()}
    sets = {}
    for t in texts:
        ws = t.encode().translate(simhash._LOWER).split()
        sets[ids[t]] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or {tuple(ws)}
    order = sorted(sets)
    want = set()
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                want.add((a, b))
    rooted = spark.createDataFrame([(a, a) for a in order], "th long, root long")
    got = {(r.a, r.b) for r in simhash.similar_links(docs, rooted).collect()}
    assert want and got <= want and dict(components.components(spark.createDataFrame(list(want), "a long, b long")).collect()) == dict(components.components(spark.createDataFrame(list(got), "a long, b long")).collect())


def test_texts_of_one_template_don_t_meet_in_pairs(spark, monkeypatch):
    """Texts that share 0.7 are compared a few times each, however many; those of them that are 0.8 similar are linked."""
    rng = np.random.default_rng(5)
    head = [f"t{x}" for x in range(200)]
    own = lambda n: [f"o{x}" for x in rng.integers(0, 10**9, n)]
    texts = [" ".join(head + own(40)) for _ in range(500)]
    for k in range(0, 60, 3):  # near copies of some: a few words differ, also of another length
        words = texts[k].split()
        words[50:52] = own(2)
        texts.append(" ".join(words))
        texts.append(" ".join(texts[k].split() + own(10)))
    texts += [" ".join(head + own(20)) for _ in range(3)]  # the template itself is most of these
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    similar = simhash._similar
    monkeypatch.setattr(simhash, "_similar", lambda docs, pairs, words: asked.append(pairs.count()) or similar(docs, pairs, words))
    got = {r.doc_id: r.component_id for r in simhash._grouped(df, 3, True).collect()}
    assert sum(asked) < 40 * len(texts)
    assert got == {d: c for d, _, c in brute.simhash_groups(list(enumerate(texts)), similar=True)}


def test_rare_pairs_hold_all_similar_ones(spark):
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(60):
        base = rng.choice(400, int(rng.integers(5, 60)), replace=False)
        for _ in range(int(rng.integers(1, 5))):
            kept = base[rng.random(len(base)) > rng.choice([0.0, 0.1, 0.2])]
            sets.append(sorted({*kept.tolist(), *rng.choice(400, int(rng.integers(0, 5))).tolist(), 7}))
    rows = [(k, s) for k, s in enumerate(sets)]
    got = simhash.rare_pairs(spark.createDataFrame(rows, "th long, grams array<long>"), spark.createDataFrame([(k, len(s), k) for k, s in rows], "th long, n long, top long"))
    found = {(r.a, r.b) for r in got.collect()}
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})}
    assert len(want) > 30 and want <= found and len(found) < len(sets) ** 2 / 4


def test_nothing_that_grows_is_broadcast(spark, small, monkeypatch):
    """By the size of their files, these tables would all be broadcast; only the bounded hashes of texts may be."""
    from agestrata.functions import components as stars

    plans, write = [], simhash.written
    note = lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name)
    monkeypatch.setattr(simhash, "written", note)
    monkeypatch.setattr(stars, "written", note)
    out = simhash.one_of_each(small, similar=True)
    plans += [("kept", out._jdf.queryExecution().executedPlan().toString()), ("links", simhash.links(spark.range(9).toDF("fp"))._jdf.queryExecution().executedPlan().toString())]
    assert sorted({name for name, plan in plans if "Broadcast" in plan} - {"simhash-sets"}) == []
    assert out.count() > 0
