"""Top-k, shards, toxicity, packing, pages, near-duplicates: results against plain Python."""

import collections
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradewright.llm import copies, nearest, packing, pages, sharding, simhash, toxicity
from tests.llm.cases import BASE, hard_documents, no_documents, plain
from tests.oracle import plan

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- top-k ---------------------------------------------------------------------


def naive_top(rows, every, k):
    sound = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(sound):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(sound) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("dims, shard", [(3, 40), (8, 16), (2, 1000)])
def test_top_k(spark, dims, shard):
    rng = np.random.default_rng(dims)
    rows = [(int(i), rng.normal(0, 1, dims).round(2).tolist()) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a very common vector
    rows += [(0, rows[5][1]), (0, rows[5][1]), (7, None), (None, rows[1][1]), (8, [None] * dims), (20, [float("nan")] * dims), (40, [float("inf")] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit(1)).withColumn("shard", F.lit(2))
    made = nearest.nearest(df, every=20, k=20, shard=shard, block=8)
    assert plain(made, "query_id", "rank", "vec_id", "score") == naive_top(rows, 20, 20)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [])], "vec_id long, embedding array<double>")
    assert plain(nearest.nearest(df), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 4096), (0, 2, 2, 0)]
    assert nearest.nearest(df.where("1 = 0")).count() == 0


def test_large_numbers_are_exact():
    q, v = np.array([[2**30, 1]]), np.array([[2**30, 1], [2**30, 0]])
    assert nearest.exact(q, v) is np.int64
    tree = nearest.build(v)
    made = nearest.search(tree, v, np.array([5, 6]), np.array([0, 1]), q, np.array([9]), [-(2**62)])
    assert [a.tolist() for a in made[0]] == [[2**60 + 1, 2**60], [5, 6]]


# --- shards ----------------------------------------------------------------------


@pytest.mark.parametrize("part_bytes", [1 << 30, 2_000])
def test_shards(spark, part_bytes):
    texts = [f"text {i % 97} " * (1 + i % 13) for i in range(1500)] + ["a very common text " * 4] * 700
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("h", F.lit(1))
    made = sharding.shard(docs, 7, part_bytes=part_bytes).collect()
    by = collections.defaultdict(list)
    for r in made:
        by[r["shard"]].append(r)
    sizes = {s: sum(len(r["text"].encode()) + 16 for r in rows) for s, rows in by.items()}
    mean = sum(sizes.values()) / 7
    assert sorted(by) == list(range(7)) and len(made) == len(texts)
    assert max(abs(x - mean) for x in sizes.values()) < 0.02 * mean + 200
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in by.values())
    # The law does not depend on how the rows are dealt.
    again = sharding.shard(docs.repartition(5), 7, part_bytes=part_bytes)
    assert plain(again, "doc_id", "shard", "slot") == sorted((r["doc_id"], r["shard"], r["slot"]) for r in made)


def test_shards_bear_hard_rows(spark):
    docs = hard_documents(spark)
    made = sharding.shard(docs, 4)
    assert plain(made, "doc_id", "text") == plain(docs, "doc_id", "text")
    slots = collections.defaultdict(list)
    for r in made.collect():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(no_documents(spark), 4).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), max_size=40), st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), max_size=6))
def test_boundaries_below_a_row(rows, bounds):
    bounds = sorted(bounds)
    column = lambda pairs, i: np.array([p[i] for p in pairs], dtype=np.int64)
    got = sharding.below(column(rows, 0), column(rows, 1), column(bounds, 0), column(bounds, 1))
    assert got.tolist() == [sum(b <= r for b in bounds) for r in rows]


# --- packing ---------------------------------------------------------------------


def naive_cost(at, penalty, length):
    best = np.inf
    for n in range(len(at) - 1):
        for inner in itertools.combinations(range(1, len(at) - 1), n):
            cuts = [0, *inner, len(at) - 1]
            gaps = [at[b] - at[a] for a, b in zip(cuts, cuts[1:])]
            if max(gaps) <= length:
                best = min(best, sum(length - g for g in gaps) + sum(penalty[c] for c in inner))
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 9)), min_size=1, max_size=9))
def test_cuts_are_the_cheapest(steps):
    at = [0, *np.cumsum([s for s, _ in steps]).tolist()]
    penalty = [0, *[p for _, p in steps[:-1]], 0]
    cuts = packing.best_cuts(at, penalty, 10)
    assert cuts[0] == 0 and cuts[-1] == len(at) - 1
    gaps = [at[b] - at[a] for a, b in zip(cuts, cuts[1:])]
    assert max(gaps) <= 10
    assert sum(10 - g for g in gaps) + sum(penalty[c] for c in cuts[1:-1]) == naive_cost(at, penalty, 10)


def check_pieces(rows, ids, length):
    """Every id in one piece, sequences gapless and not too long."""
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(bytes(r["ids"]))
    assert {k: sum(p["length"] for p in v) for k, v in by.items()} == {k: sum(map(len, v)) for k, v in ids.items()}
    for key, own in by.items():
        if len(ids[key]) == 1:
            whole = ids[key][0]
            at = 0
            for p in sorted(own, key=lambda p: p["start"]):
                assert p["start"] == at and p["doc_tokens"] == len(whole)
                assert np.frombuffer(p["ids"], "<u4").tolist() == whole[at: at + p["length"]]
                at += p["length"]
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length


def own_ids(docs):
    import tokenizers

    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    model.encode_special_tokens = True
    ids = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r["doc_id"]].append([*model.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    return ids


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, length, monkeypatch):
    docs = hard_documents(spark).unionByName(
        spark.createDataFrame([(100 + i, (BASE + ". ") * (i % 23)) for i in range(60)], "doc_id long, text string"), allowMissingColumns=True)
    made = packing.pack(docs.coalesce(1), VOCABULARY, RANKS, length=length).collect()
    check_pieces(made, own_ids(docs), length)
    tokens, sequences = sum(p["length"] for p in made), len({p["sequence_id"] for p in made})
    assert sequences * length < 1.35 * tokens + length
    assert packing.pack(no_documents(spark), VOCABULARY, RANKS).count() == 0


def test_blocks_do_not_show(monkeypatch):
    """A stream packed in many blocks has full sequences but for the last."""
    monkeypatch.setattr(packing, "BLOCK", 300)
    rng = np.random.default_rng(3)
    closes, opens = np.arange(50) % 7 == 0, np.arange(50) % 3 == 0
    packer, rows = packing.Packer(closes, opens, 0, 64), []
    ids = {k: [rng.integers(2, 50, rng.integers(1, 400)).tolist()] for k in range(80)}
    for k, (own,) in ids.items():
        rows += packer.add(k, np.array(own))
    rows += packer.flush()
    names = ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    made = [dict(zip(names, r)) for r in rows]
    check_pieces(made, ids, 64)
    sequences = len({p["sequence_id"] for p in made})
    assert sequences * 64 < 1.25 * sum(p["length"] for p in made)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdlr1!.\x1c\x85é"), st.characters(codec="utf-8")), max_size=60))
def test_ranks_give_the_vocabularys_ids(text):
    assert TOKENIZER.encode(text).tolist() == TOKENIZER.encode_whole(text).tolist()


TOKENIZER = packing.Tokenizer(VOCABULARY, RANKS)


def test_added_tokens_are_one_id(spark):
    """Ids are those of the library with its defaults, strings of added tokens included."""
    import tokenizers

    model = tokenizers.Tokenizer.from_file(VOCABULARY)
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end} x. ", f"One. {end}\n" + BASE, f"{' ' * 300_000}x{end}", "<|endoftext|", "<|END|>", "plain text"]
    want = {i: model.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert want[0] == [64, 50256, 65]
    for i, t in enumerate(texts):
        assert TOKENIZER.encode(t).tolist() == want[i]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    check_pieces(packing.pack(docs, VOCABULARY, RANKS, length=64).collect(), {i: [[*v, 1]] for i, v in want.items()}, 64)


def test_very_long_white_space():
    for text in (" " * 300_000 + "x", "\n" * 100_000, "x" * 100_000):
        assert TOKENIZER.encode(text).tolist() == TOKENIZER.encode_whole(text).tolist()


# --- near-duplicates ----------------------------------------------------------------


def naive_fingerprint(text):
    import xxhash

    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 3 else [" ".join(w[i: i + 3]) for i in range(len(w) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def naive_components(fps, keys):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    first = collections.defaultdict(list)
    for x, k in zip(label, keys):
        first[x].append(k)
    return [min((k for k in first[x] if k is not None), default=None) for x in label]


def test_simhash_classes(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(40):
        own = [words[j] for j in rng.integers(0, 400, 300)]
        texts.append(" ".join(own))
        for _ in range(4):  # near copies
            own[int(rng.integers(0, 300))] = "changed"
            texts.append(" ".join(own))
    docs = hard_documents(spark).unionByName(
        spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.collect()
    fps = [naive_fingerprint(r["text"]) for r in rows]
    want = [(r["doc_id"], f"{x:016x}", c) for r, x, c in zip(rows, fps, naive_components(fps, [r["doc_id"] for r in rows]))]
    assert plain(simhash.classes(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=lambda t: tuple((x is not None, x) for x in t))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [(f, n) for f, n in zip(fps, naive_components(fps, range(len(fps))))]
    assert kept.count() == len({n for _, n in ids})
    assert simhash.classes(no_documents(spark)).count() == 0 and simhash.one_of_each(no_documents(spark)).count() == 0


@pytest.mark.parametrize("cell", [1 << 16, 4])
def test_links_connect_what_distances_connect(spark, cell):
    """Dense balls around a few centres, in one bucket or dealt into cells."""
    rng = np.random.default_rng(cell)
    fps = set()
    for centre in rng.integers(0, 2**63, 6).tolist():
        for _ in range(30):
            x = centre
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << b
            fps.add(x & (2**63 - 1))
    fps = sorted(fps)
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    links = simhash.links(table, cell)
    roots = dict(simhash.components(links).collect())
    assert [roots.get(x, x) for x in fps] == naive_components(fps, fps)
    assert links.count() < 66 * len(fps)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
def test_stars_span_their_group(pairs):
    members = np.array([a * 8191 ^ b for a, b in pairs], dtype=np.int64)
    heads, others = simhash.stars(members)
    assert len(heads) <= max(0, len(set(members.tolist())) - 1)
    label = {x: x for x in members.tolist()}
    for a, b in zip(heads, others):
        old, new = label[b], label[a]
        label = {x: new if y == old else y for x, y in label.items()}
    for a, b in itertools.combinations(set(members.tolist()), 2):
        if (a ^ b).bit_count() <= 3:
            assert label[a] == label[b]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(-5, -4)]
    made = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert made == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}, -5: -5, -4: -5}


def jaccard_five(a, b):
    sets = []
    for text in (a, b):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({" ".join(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def edited_texts():
    """Texts with copies of which 1 to 8 words are replaced: similarities around 0.8."""
    rng = np.random.default_rng(9)
    texts = []
    for i in range(40):
        own = [f"w{j}" for j in rng.integers(0, 3000, 200)]
        texts.append(" ".join(own))
        for n in range(1, 9):
            other = list(own)
            for j in rng.choice(200, n, replace=False):
                other[j] = f"new{i}-{n}-{j}"
            texts.append(" ".join(other))
    return texts


@pytest.mark.parametrize("cell", [copies.CELL, 1000])
def test_near_copies_of_a_fifth(spark, cell):
    """Groups are those of all pairs with a 5-word Jaccard similarity of 0.8 or more."""
    texts = edited_texts()
    docs = hard_documents(spark).unionByName(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True)
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if i // 9 == j // 9 and label[i] != label[j] and jaccard_five(texts[i], texts[j]) >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    kept = copies.one_of_each(docs, cell=cell)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id >= 1000").collect()) == sorted({1000 + x for x in label})
    assert kept.where("doc_id in (1, 2) or doc_id is null").count() == 2  # the copies of 1 are gone
    assert 40 < len(set(label)) < 300 and copies.one_of_each(no_documents(spark)).count() == 0


@pytest.mark.parametrize("cell", [copies.CELL, 1000])
def test_fingerprints_find_near_copies_without_bands(spark, monkeypatch, cell):
    """Near copies that no band finds: similar pairs within three bits are linked, by whole texts."""
    monkeypatch.setattr(copies, "bands_of", lambda hashes: [])
    texts = edited_texts()
    # Fingerprints count repeats, so these are equal there, but their sets of shingles are not alike.
    texts += ["one two three four five " * 60 + " ".join(f"tail{k}-{i}" for i in range(40)) for k in range(9)]
    fps = [naive_fingerprint(t) for t in texts]
    assert len(set(fps[-9:])) == 1
    label = list(range(len(texts)))
    wanted = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        if i // 9 == j // 9 and (fps[i] ^ fps[j]).bit_count() <= 3 and jaccard_five(texts[i], texts[j]) >= 0.8:
            wanted += 1
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    # Chains of fingerprints bring further pairs together, which are linked if they are alike.
    met = naive_components(fps, range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if met[i] == met[j] and label[i] != label[j] and jaccard_five(texts[i], texts[j]) >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in copies.one_of_each(docs, cell=cell).select("doc_id").collect()}
    assert wanted > 20 and kept == set(label) and len(kept) < len(texts) and set(range(360, 369)) <= kept


def test_wanted_texts(spark):
    """No wanted row is lost, most others go, whatever the number of bits."""
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("mark"))
    wanted = df.where("id % 50 = 0").select(F.col("mark").alias("w"))
    for most, others in ((1 << 28, 0.1), (1 << 15, 1.0)):
        got = {r["id"] for r in copies.among(df, "mark", wanted, "w", most).collect()}
        assert set(range(0, 20_000, 50)) <= got and len(got) <= 400 + others * 19_600
    assert copies.among(df, "mark", wanted.where("1 = 0"), "w").count() == 0


def test_texts_move_once(spark, monkeypatch):
    """One exchange serves the join and the choice of one row."""
    docs = spark.createDataFrame([(i, f"t {i}") for i in range(50)], "doc_id long, text string")
    first = docs.select(F.struct(F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark")).alias("first"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(simhash.rows_of(docs, first, "doc_id", "text"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange (") == 2  # the documents and the list of those that stay


# --- toxicity -----------------------------------------------------------------------


def test_toxicity_learns_words(spark):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        own = [words[j] for j in rng.integers(0, 300, 60)]
        toxic = i % 4 == 0
        if toxic:
            own[int(rng.integers(0, 60))] = ["vile", "awful", "nasty"][i % 3]
        texts.append(" ".join(own))
        labels.append(int(toxic))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([*enumerate(labels), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    rows = toxicity.judge(docs, model).join(marks.where("doc_id is not null and toxic is not null"), "doc_id")
    held = rows.where(toxicity.held_out("doc_id")).collect()
    assert len(held) > 50 and sum(r["predicted"] == r["toxic"] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in held)
    hard = hard_documents(spark)
    made = toxicity.judge(hard, model)
    assert made.count() == hard.count() and made.where("score is null").count() == 0
    assert toxicity.keep_clean(hard, model).columns == hard.columns
    assert toxicity.keep_clean(no_documents(spark), model).count() == 0
    # Only the text counts.
    assert plain(toxicity.judge(docs.withColumn("doc_id", F.lit(0)), model), "score") == plain(toxicity.judge(docs, model), "score")


def test_toxicity_without_labels(spark):
    docs = hard_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.judge(docs, toxicity.learn(docs, none)).collect()} == {0}


def test_pools_are_the_largest_responses():
    rng = np.random.default_rng(2)
    filters = [rng.normal(0, 1, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    width = len(toxicity.WIDTHS) * toxicity.FILTERS
    embed = np.vstack([np.zeros(toxicity.DIM), rng.normal(0, 1, (9, toxicity.DIM))])
    model = toxicity.Model(np.arange(9), embed, filters, rng.normal(0, 1, width), rng.normal(0, 1, width), 0.3)
    texts = [rng.integers(0, 10, n) for n in (1, 0, 5, 30, 2)]
    for got, own in zip(toxicity.logits(model, model.tables(), texts), texts):
        laid = [*own.tolist(), 0, 0] if len(own) else [0, 0, 0]
        pools = []
        for f in filters:
            every = [sum(embed[laid[i + j]] @ f[j] for j in range(len(f))) for i in range(max(1, len(own)))]
            pools.append(np.max(every, axis=0))
        want = np.maximum(np.concatenate(pools) + model.bias, 0) @ model.out + model.base
        assert got == pytest.approx(want, rel=1e-4, abs=1e-4)


# --- pages --------------------------------------------------------------------------


def page(article, i, host="a.example.com", extra=""):
    return (i, f"https://{host}/p/{i}", f"""<!DOCTYPE html><html><head><title>T{i}</title><style>p{{x}}</style><script>var a="</p><p>no";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu {i}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content">{article}</div><aside>See also</aside>{extra}<div class="ad">Buy {i}</div><form><label>Mail</label></form>
<section class="comments"><p>First!</p></section><footer>&copy; {i}</footer></body></html>""")


def test_pages(spark):
    rows = []
    want = {}
    for i in range(30):
        article = f"<h2>Title&nbsp;{i}</h2><p>One <b>bold</b>ly said &amp; done {i}.<br>\n  Next line<p>Unclosed &lt;{i}&gt;<ul><li>a {i}<li>b {i}</ul>tail {i}"
        rows.append(page(article, i))
        want[i] = f"Title {i}\nOne boldly said & done {i}. Next line\nUnclosed <{i}>\na {i}\nb {i}\ntail {i}"
    rows.append(page("<p>alone</p>", 50, "b.example.com"))
    want[50] = "alone"
    rows += [(60, None, None), (61, "x", ""), (62, "https://c/", "plain text only"), (63, None, "<p>no host"), (64, "https://c/2", "<script>open")]
    want |= {60: "", 61: "", 62: "plain text only", 63: "no host", 64: ""}
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("slots", F.lit(1)).withColumn("host", F.lit(2))
    made = pages.extract(df)
    assert {r["page_id"]: r["main_text"] for r in made.collect()} == want
    assert made.count() == len(rows) and pages.extract(df.where("1 = 0")).count() == 0
    slots = {r["host"]: r["slots"][-1] for r in pages.templates(df).collect() if r["slots"]}
    assert tuple(slots["a.example.com"]) == (3, path_of("html", "body", "div#content"), None)


def path_of(*labels):
    made = 0
    for label in labels:
        made = pages._hash(made, label)
    return pages._signed(made)


WRAPPERS = [
    "<div class='layout with-sidebar'>{}</div>", "<article class='post no-comments'>{}</article>", "<main class='has-sidebar'>{}</main>",
    "<form id='aspnetForm'>{}</form>", "<form><div class='page sidebar'>{}</div></form>", "<article class='share'>{}</article>",
    "<div class='social'><p>Stray</p><main>{}</main></div>",
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_names_do_not_hold_on_the_article(wrapper):
    article = "<p>" + "The article goes on for some time. " * 9 + "</p>"
    made = pages.text_of(f"<body><nav>Menu</nav>{wrapper.format(article + '<div class=share>Share</div>')}<div class='comments'>First!</div></body>", [], set())
    assert made.replace("Stray\n", "") == ("The article goes on for some time. " * 9).strip()


def test_long_comments_stay_beside():
    made = pages.text_of("<body><div><p>Short.</p></div><div class='comments'>" + "<p>Much is said here.</p>" * 50 + "</div></body>", [], set())
    assert made == "Short."


def test_template_words_are_left_out(spark):
    """A block that nearly all different pages of a host print is the template's; a common one is not."""
    rows = [page(f"<p>Share this page</p><p>Text {i}</p>" + ("<p>common</p>" if i % 2 else ""), i) for i in range(20)]
    made = {r["page_id"]: r["main_text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert made == {i: f"Text {i}" + ("\ncommon" if i % 2 else "") for i in range(20)}
    copies = [(i, rows[0][1], rows[0][2]) for i in range(20)]
    made = {r["main_text"] for r in pages.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()}
    assert made == {"Share this page\nText 0"}


def test_equivalence_classes(spark):
    rows = [page("<p>x</p>" * (i + 1), i) for i in range(6)]
    made = pages.classes(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    together = [{t["path"] for t in r["tokens"]} for r in made]
    body = ("html", "body")
    assert any({path_of("html"), path_of(*body), path_of(*body, "div#content"), path_of(*body, "nav"), path_of(*body, "footer")} <= t for t in together)
    assert {path_of(*body, "div#content", "p")} in together


@pytest.mark.parametrize("unit", [
    "<a ", "<style ", "<div>", "<div><p>x", "<!--", "<b>", "<b></i>", "<i></div>", "<form><p>y", "<a \"", "<a 'x\" ", "<td>", "<li>z", "<h1><b>", "<",
    "<form class='ad'>x", "&amp;"])
def test_malformed_pages_take_time_in_proportion(unit):
    """The time for a page eight times as long is far from 64 times as long."""
    def seconds(n):
        page = unit * n
        start = time.process_time()
        pages.read_page(page)
        return time.process_time() - start

    n = 16_000 // len(unit)
    seconds(n)
    assert seconds(8 * n) < 24 * max(seconds(n), 0.02)


def test_very_long_and_malformed_pages(spark):
    units = ["<a ", "<style ", "<div>", "<div><p>x", "<!--", "<form><p>y", "<a \"", "text "]
    rows = [(i, f"http://host{i % 3}.example/{i}", unit * (300_000 // len(unit))) for i, unit in enumerate(units)]
    made = {r["page_id"]: r["main_text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert set(made) == set(range(len(units))) and made[7] == ("text " * 60_000).strip() and made[4] == ""
    assert made[3] == "\n".join(["x"] * (300_000 // 9))


def test_ends_of_tags():
    """What closes a tag, a comment and a raw element, and what is text."""
    def texts(page):
        return [t for _, t in pages.read_page(page)[1]]

    assert texts("<p>a<b c='>'>d</b>") == ["ad"] and texts("a <b c=\">\" d") == ['a <b c=">" d']
    assert texts("a<!-- <p>b --> c<!-- d") == ["a c"] and texts("a<script>if (b < c) {}</script >d<style>e") == ["ad"]
    assert texts("1 < 2 > 1 <3") == ["1 < 2 > 1 <3"] and texts("<a 'x <p>y") == ["<a 'x", "y"]
    assert texts("<p>a<i>b<div>c</i>d</div>e") == ["ab", "cd", "e"]
