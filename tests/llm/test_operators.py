import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, minhash, nearest, packing, pseudolikelihood, reputation, suffixes, templates, toxicity, warc
from loomgraph.llm import textkernel as K

WORD = re.compile(r"[0-9a-zA-Z\u0080-\U0010ffff]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, th string"


def split(text):
    return WORD.findall((text or "").lower())


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 0.5, "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    base = [prose(rng, 120, 3000) for _ in range(12)]
    shared = prose(rng, 60, 3000)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].upper() + "!!"), (22, base[1].replace(" w1", " v1", 3)), (23, base[2] + " " + shared), (24, shared + " " + base[3])]
    rows += [(None, None), (30, ""), (31, "a"), (None, base[4]), (33, "short one"), (33, "short one"), (34, prose(rng, 20000, 3000)), (35, None)]
    return rows, frame(spark, rows)


def test_words_equal_regular_expression():
    texts = ["", None, "Ab, cé-d  É1!x", "end", "next\n", "Ωmega ß"]
    w = K.words(pa.array(texts, pa.string()))
    ids = {}
    for i, t in enumerate(texts):
        for s, h in zip(split(t), w.doc(i), strict=True):
            assert ids.setdefault(s, h) == h
    assert len(set(ids.values())) == len(ids)


def brute_groups(rows, threshold):
    live = [(n, i, set(tuple(w[j : j + k]) for j in range(len(w) - k + 1))) for n, (i, t) in enumerate(rows) if (w := split(t)) for k in [min(3, len(w))]]
    parent = {n: n for n, *_ in live}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (n, _, s) in enumerate(live):
        for m, _, t in live[:a]:
            if len(s & t) / len(s | t) >= threshold:
                parent[root(n)] = root(m)
    groups = {}
    for n, i, _ in live:
        groups.setdefault(root(n), []).append(i)
    return sorted(sorted(map(str, g)) for g in groups.values() if len(g) > 1)


def test_near_duplicates_equal_brute_force(corpus):
    rows, docs = corpus
    groups = {}
    for r in minhash.near_duplicates(docs).collect():
        groups.setdefault(r["kept_doc_id"], []).append(r["doc_id"])
    assert sorted(sorted(map(str, g)) for g in groups.values()) == brute_groups(rows, minhash.THRESHOLD)
    kept = minhash.dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - sum(len(g) - 1 for g in groups.values())
    assert minhash.dedup(docs.limit(0)).count() == 0


def brute_repeats(docs, least):
    """Maximal repeats at two places or more: words -> places."""
    out = {}
    seen = {}
    for d, w in docs.items():
        for i in range(len(w) - least + 1):
            seen.setdefault(tuple(w[i : i + least]), []).append((d, i))
    todo = [(k, v) for k, v in seen.items() if len(v) > 1]
    while todo:
        words, places = todo.pop()
        after = {}
        for d, i in places:
            nxt = docs[d][i + len(words)] if i + len(words) < len(docs[d]) else (d, "end")
            after.setdefault(nxt, []).append((d, i))
        for nxt, own in after.items():
            if isinstance(nxt, str) and len(own) > 1:
                todo.append((words + (nxt,), own))
        before = {docs[d][i - 1] if i else (d, "start") for d, i in places}
        if len(after) > 1 and len(before) > 1:
            out[words] = sorted(places, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    return out


def repeat_rows(spark):
    rng = random.Random(5)
    a, b, c, d = prose(rng, 70), prose(rng, 90), prose(rng, 55), prose(rng, 64)
    return [
        (1, f"{prose(rng, 9)} {a} {prose(rng, 9)}"), (2, f"{a} {b}"), (3, f"{b} {c}"), (4, f"x {b} y {c}"), (5, f"{a} {b}"), (6, " ".join(["p q r"] * 40)),
        (7, "z " + " ".join(["p q r"] * 30)), (8, None), (9, c), (10, f"{d} {prose(rng, 7)} {d} {prose(rng, 30)} {d[:-3]}"), (11, f"{d} u {a} v {d}"), (12, f"{a} {b}"), (13, ""),
    ]


def test_repeats_equal_brute_force(spark):
    rows = repeat_rows(spark)
    docs = {i: split(t) for i, t in rows if t}
    want = brute_repeats(docs, suffixes.MIN_WORDS)
    frame_ = frame(spark, rows)
    listed = set()
    for extra in (frame_, frame_.union(frame_.filter("doc_id in (2, 10)"))):  # rows that repeat in full are one document
        found, size = {}, {}
        same = {i: [j for j in docs if docs[j] == docs[i]] for i in docs}
        for r in suffixes.maximal_repeats(extra).collect():
            size[r["repeat_id"]] = r["n_words"], r["n_docs"], r["n_places"]
            assert r["n_copies"] == len(same[r["doc_id"]])
            if r["doc_id"] == min(same[r["doc_id"]]):
                found.setdefault(r["repeat_id"], []).extend((d, r["first_word"] + r["step"] * k) for k in range(r["times"]) for d in same[r["doc_id"]])
            else:
                assert r["first_word"] == 0 and r["n_words"] == len(docs[r["doc_id"]])
                listed.add(r["doc_id"])
        assert listed == {5, 12}
        got = {}
        for k, places in found.items():
            d, p = min(places)
            assert size[k][1:] == (len({d for d, _ in places}), len(places))
            got[tuple(docs[d][p : p + size[k][0]])] = sorted(places)
        assert got == want
    assert suffixes.maximal_repeats(frame_.limit(0)).count() == 0


def test_nested_repeats_are_all_repeats(spark):
    """The places under a repeat and all below it are those of the flat form; rows grow with places, not with pairs of near copies."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    near = []
    for i in range(30):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(400)] = f"x{i}"
        near.append((i, " ".join(words)))
    loop = " ".join(f"p{i}" for i in range(7))
    rows = near + [(50, " ".join([loop] * 20)), (51, " ".join([loop] * 12 + ["end"])), (None, near[3][1] + " more"), (60, near[5][1]), (61, near[5][1]), (70, "few words"), (71, None)]
    docs = frame(spark, rows).repartition(3)

    def places(found):
        out = {}
        for r in found:
            own = out.setdefault(r["repeat_id"], set())
            own |= {(r["doc_id"], r["first_word"] + t * r["step"]) for t in range(r["times"])} if r["doc_id"] not in (60, 61) else set()
        return out

    flat, nested = suffixes.maximal_repeats(docs).collect(), suffixes.nested_repeats(docs).collect()
    facts = lambda found: {(r["repeat_id"], r["n_words"], r["n_docs"], r["n_places"]) for r in found}
    assert facts(flat) == facts(nested) and len(nested) < len(flat) / 4
    copies = lambda found: {(r["doc_id"], r["repeat_id"], r["n_copies"]) for r in found if r["doc_id"] in (60, 61)}
    assert copies(flat) == copies(nested) and len(copies(flat)) == 2
    got, parent, size = places(nested), {r["repeat_id"]: r["parent_id"] for r in nested}, {r["repeat_id"]: r["n_words"] for r in nested}
    for x in sorted(got, key=lambda x: -size[x]):
        if parent[x] is not None:
            assert size[parent[x]] < size[x]
            got[parent[x]] |= got[x]
    assert got == places(flat)
    assert suffixes.nested_repeats(docs.limit(0)).count() == 0


def test_suffix_array_equals_sorting():
    rng = random.Random(15)
    words = np.array([rng.randrange(1, 3) for _ in range(400)], np.uint64)
    words[:50] = words[100:150] = words[200:250] = words[300:350] = 1
    first = np.array([0, 100, 200, 300] * 30) + 0
    end = np.array([rng.randrange(f + 50, min(400, f + 100)) for f in first.tolist()])
    order, lcp = suffixes.suffix_array(words, first, end, np.array([7, 7, 7, 9] * 30))
    key = lambda i: ([7, 7, 7, 9][i % 4], words[first[i] : end[i]].tolist())
    assert [key(i) for i in order] == sorted(key(i) for i in range(120))
    for j, (a, b) in enumerate(zip(order[:-1], order[1:])):
        x, y = key(a), key(b)
        same = next((n for n, (u, v) in enumerate(zip(x[1], y[1])) if u != v), min(len(x[1]), len(y[1])))
        assert lcp[j] == (same if x[0] == y[0] else -1)


def test_remove_repeats_equals_brute_force(spark):
    rows = [(None if i == 1 else i, t) for i, t in repeat_rows(spark)]
    rank = {i: (i is None, i or 0) for i, _ in rows}
    docs = {i: split(t) for i, t in rows if t}
    gone = {i: set() for i in docs}
    for words, places in brute_repeats(docs, suffixes.MIN_WORDS).items():
        for d, p in sorted(places, key=lambda x: (rank[x[0]], x[1]))[1:]:
            gone[d].update(range(p, p + len(words)))
    want = {i: [w for k, w in enumerate(words) if k not in gone[i]] for i, words in docs.items()}
    got = {r["doc_id"]: r["text"] for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert {i: split(t) for i, t in got.items() if t} == {i: w for i, w in want.items() if w} and got[8] is None and got[13] == ""


def test_pipeline_stages_and_run(spark, tmp_path):
    """All five stages over planted cases; each keeps the columns and the clean documents."""
    import corpus_pipeline

    rng = random.Random(21)
    clean = [prose(rng, 80, 5000) for _ in range(60)]
    shared, item = prose(rng, 60, 5000), prose(rng, 30, 5000)
    rows = [(i, t + (" grobnik zlumpf" if i % 6 == 0 else "")) for i, t in enumerate(clean)]
    rows += [(100, clean[1]), (101, clean[1]), (102, clean[2] + " one more"), (103, f"{prose(rng, 40, 5000)} {shared}"), (104, f"{shared} {prose(rng, 40, 5000)}"), (105, f"{prose(rng, 40, 5000)} {item} {prose(rng, 9, 5000)}"), (106, None), (107, ""), (None, "lonely text"), (108, item)]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    toxic, expect = {i for i in range(60) if i % 6 == 0}, {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        expect[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    everything = {i for i, _ in rows}
    assert set(expect["toxicity"]) == everything - toxic
    assert set(expect["near_duplicates"]) == everything - toxic - {100, 101, 102}
    assert split(expect["suffix_array"][104])[:60] != split(shared) and split(shared)[:1] == split(expect["suffix_array"][103])[40:41]
    assert item.split()[3] not in split(expect["decontamination"][105]) and 108 not in expect["decontamination"]
    assert all(expect["decontamination"][i] == t for i, t in rows if isinstance(i, int) and i < 60 and i not in toxic)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(expect["decontamination"])
    bins = {}
    for r in packed:
        bins[r["bin_id"]] = bins.get(r["bin_id"], 0) + r["n_tokens"]
    assert max(bins.values()) <= packing.MAX_TOKENS


def test_remove_repeats_keeps_the_first(spark):
    rng = random.Random(6)
    p = prose(rng, 60, 900)
    left, right = prose(rng, 30, 900), prose(rng, 30, 900)
    docs = frame(spark, [(2, f"{left} {p}."), (1, f"{p} {right}"), (3, p), (4, None), (5, ""), (None, f"{p} {right}"), (6, " ".join(["é b c"] * 30))])
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    assert set(got) == {1, 2, 4, 5, 6}
    assert got[1]["text"] == f"{p} {right}" and split(got[2]["text"]) == split(left) and got[2]["n_chars"] == len(got[2]["text"])
    assert split(got[6]["text"]) == ["é", "b", "c"]
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    items = [(i, [rng.randrange(4) for _ in range(rng.randrange(1, 12))]) for i in range(8)]
    machine = decontaminate.Automaton(items)
    for _ in range(30):
        stream = [rng.randrange(5) for _ in range(40)]
        grams = {tuple(w[i:j]): set() for _, w in items for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        for k, w in items:
            for i in range(len(w)):
                for j in range(i + 1, len(w) + 1):
                    grams[tuple(w[i:j])].add(k)
        longest = [max([n for n in range(1, i + 2) if tuple(stream[i + 1 - n : i + 1]) in grams], default=0) for i in range(40)]
        want = [(i + 1 - n, i + 1, grams[tuple(stream[i + 1 - n : i + 1])]) for i, n in enumerate(longest) if n >= 2 and (i == 39 or longest[i + 1] != n + 1)]
        assert [(a, b, machine.of[s]) for a, b, s in machine.spans(stream, 2)] == want


def test_decontamination(spark):
    rng = random.Random(2)
    item, other = prose(rng, 30, 900), prose(rng, 40, 900)
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (None, ""), (2, other)], "item_id long, text string")
    words = item.split()
    docs = frame(spark, [(1, f"clean start {item.upper()}! clean end"), (2, "only " + " ".join(words[:16])), (3, "few " + " ".join(words[:6])), (4, item), (5, None), (6, ""), (7, prose(rng, 500, 900) + " zzz")])
    assert {r["doc_id"]: r["n_removed"] for r in decontaminate.contaminated(docs, bench).collect()} == {1: 30, 2: 16, 4: 30}
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7} and split(got[1]) == "clean start clean end".split() and got[3].startswith("few w")
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 7


def test_decontamination_credits_every_item(spark):
    rng = random.Random(12)
    long = [f"u{i}" for i in range(60)]
    short = long[20:28]
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, "tiny two")], "item_id long, text string")
    docs = frame(spark, [(1, f"{prose(rng, 20)} {' '.join(long[20:29])} {prose(rng, 20)}"), (2, "x tiny two y"), (3, "x " + " ".join(long[5:20]) + " tiny two")])
    made = [sorted((r["doc_id"], r["n_removed"], r["item_ids"], r["spans"]) for r in decontaminate.contaminated(docs, bench, shard_words=n).collect()) for n in (1, 1000)]
    assert made[0] == made[1] and [x[:3] for x in made[0]] == [(1, 8, [2]), (2, 2, [3]), (3, 17, [1, 3])]


def test_decontamination_counts_words_of_the_item(spark):
    rng = random.Random(13)
    item = [f"v{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    stock = " ".join(item[:5])
    docs = frame(spark, [(1, f"{stock} {prose(rng, 9)} {stock} {prose(rng, 9)} {stock}"), (2, f"{stock} {prose(rng, 9)} {' '.join(item[9:14])}")])
    assert {r["doc_id"]: r["n_removed"] for r in decontaminate.contaminated(docs, bench).collect()} == {2: 10}


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(80)] + [(90, None), (91, ""), (92, prose(rng, 500)), (1, "again")]
    parts = frame(spark, rows).selectExpr("doc_id", "array(struct(text, doc_id % 2 = 0 AS loss)) AS parts")
    got = packing.pack(parts, "doc_id", (100, 5, 40)).collect()
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        assert sum(r["n_tokens"] for r in own) <= 100 and len(own) <= 5 and sum(r["loss_tokens"] for r in own) <= 40
    assert sum(r["n_tokens"] for r in got) == sum(len(split(t)) for _, t in rows)
    text = "".join(r["text"] for r in sorted((r for r in got if r["doc_id"] == 92), key=lambda r: r["piece"]))
    assert text == dict(rows)[92]


def test_packing_queries(spark):
    turns = spark.createDataFrame([(1, 1, "assistant", "b c"), (1, 0, "user", "a"), (1, None, None, "first"), (None, 0, "assistant", None), (2, 0, "user", "x"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string").withColumn("bin_id", F.lit("clash"))
    got = packing.pack_conversations(turns).collect()
    text = {r["conv_id"]: (r["text"], r["n_tokens"], r["loss_tokens"]) for r in got}
    assert text == {1: ("first\na\nb c\n", 4, 2), 2: ("x\nx\n", 2, 0), None: ("\n", 0, 0)}
    assert packing.pack_conversations(turns.limit(0)).count() == 0
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "é " * 5000), (None, "x")])
    rows = packing.pack_documents(docs).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["n_tokens"]) for r in rows) == [(0, 0, 1), (1, 0, 2), (1, 0, 2), (2, 0, 0), (3, 0, 0), (4, 0, 4096), (4, 1, 904)]
    assert packing.pack_documents(docs.limit(0)).count() == 0
    again = packing.pack_documents(docs.orderBy(F.desc("doc_id")).coalesce(1)).collect()
    assert again == packing.pack_documents(docs.orderBy("text").coalesce(1)).collect()
    with pytest.raises(ValueError):
        packing.pack(docs.selectExpr("doc_id", "array(struct(text, true AS loss)) AS parts"), "doc_id", (10, 4, 0))


def test_packing_equals_plain_heuristic():
    rng = np.random.default_rng(4)
    demand = np.stack([rng.integers(1, 50, 60), np.ones(60, int), rng.integers(0, 20, 60)], axis=1)
    limits = (100, 6, 40)
    weight, left, want, b = (demand / limits).mean(axis=0), set(range(60)), {}, 0
    while left:
        room = np.array(limits, float)
        while fits := [i for i in left if (demand[i] <= room).all()]:
            score = {i: float((demand[i] / limits * weight) @ (room / limits)) for i in fits}
            top = max(score.values())
            best = min(i for i in fits if score[i] > top - 1e-12)
            want[best], room = b, room - demand[best]
            left.remove(best)
        b += 1
    got = packing.assign(demand, limits)
    assert sum(int(got[i] != want[i]) for i in range(60)) == 0


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["grobnik", "zlumpf"]
    rows = [(i, prose(rng, 40, 300) + (f" {rng.choice(bad)} {prose(rng, 10, 300)}" if i % 4 == 0 else "")) for i in range(400)]
    docs = frame(spark, rows + [(900, None), (901, ""), (902, "x")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, labels).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(300, 400)) >= 97 and not (got[900] or got[901] or got[902])
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not t for t in got.values())
    assert toxicity.keep_clean(docs, labels.filter("toxic = 0")).count() == len(rows) + 3


def test_toxicity_features_and_ratios_equal_dictionaries():
    texts = ["Ab, cé!d", "", None, "zz top zz", "x", "grobnik grobnik"]
    doc, bucket, _ = toxicity.features(pa.array(texts, pa.string()))
    norm = lambda t: re.sub(r"[^0-9a-z\u0080-\U0010ffff]+", " ", (t or "").lower())
    name = {}
    for i, t in enumerate(texts):
        grams = {norm(t)[j : j + n] for n in toxicity.SIZES for j in range(len(norm(t)) - n + 1)}
        assert len(set(bucket[doc == i].tolist())) == len(grams)
        for g in grams:
            alone = set(toxicity.features(pa.array([t]))[1].tolist())
            name.setdefault(g, set(alone)).intersection_update(alone)
    rng = random.Random(2)
    texts = [prose(rng, 20, 60) + (" grobnik" if i % 2 else "") for i in range(100)]
    model = toxicity.fit(pa.array(texts), np.array([i % 2 for i in range(100)]))
    use = [i for i in range(100) if i % 5 != 4]
    sets = {i: set(toxicity.features(pa.array([texts[i]]))[1].tolist()) for i in use}
    pos, neg = ([sets[i] for i in use if i % 2 == k] for k in (1, 0))
    for b in set().union(*sets.values()):
        p, n = sum(b in s for s in pos), sum(b in s for s in neg)
        r = np.log((p + 0.5) / (len(pos) + 1)) - np.log((n + 0.5) / (len(neg) + 1))
        assert (model.weights[b] != 0) == (p + n >= 4 and abs(r) >= 2.0)
        assert model.weights[b] == 0 or np.sign(model.weights[b]) == np.sign(r)


def test_tasks_give_their_memory_back():
    """A worker that keeps what a task has freed leaves less for the JVM beside it."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6  # noqa: E731, SIM115
    kept = []

    def run(batches):
        many = [np.ones(50_000, np.uint8) for _ in range(6000)]
        kept.append(np.ones(50_000, np.uint8))  # lies above them, so that the heap doesn't shrink by itself
        assert resident() > before + 250
        yield from batches
        del many

    for task, least, most in ((run, 150, 1000), (K.tidy(run), -1000, 100)):
        K.release()
        before = resident()
        assert list(task(iter([1, 2]))) == [1, 2]
        assert least < resident() - before < most


def test_toxicity_never_rejects_texts_without_ngrams(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30, 200) + (" grobnik zlumpf" if i % 10 else "")) for i in range(200)]
    docs = frame(spark, rows + [(900, None), (901, ""), (902, "é"), (903, "grobnik " * 9000), (7, rows[7][1]), (7, rows[7][1])])
    labels = spark.createDataFrame([(i, 1, int(i % 10 > 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["toxic"], r["toxicity"]) for r in toxicity.score(docs, labels).collect()}
    assert got[900] == got[901] == got[902] == (False, 0.0) and got[903][0]
    assert {900, 901, 902} <= {r["doc_id"] for r in toxicity.keep_clean(docs, labels).collect()}
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0 and toxicity.score(docs, labels.limit(0)).filter("toxic").count() == 0


def test_pseudo_likelihood_equals_plain_loops():
    """Probabilities and gradients against loops over words and finite differences."""
    P = pseudolikelihood
    rng = np.random.default_rng(3)
    flat = (P.start(rng.integers(0, 50, P.SIZE)) + rng.standard_normal(len(P.start(np.ones(P.SIZE)))) * 0.1).astype(np.float32)
    words = rng.integers(0, P.SIZE, 30)
    around = P.contexts(words.astype(np.int32), np.array([0, 12, 12, 30]))

    def plain(flat, i):
        emb, b, wc, bc, ww, bw = (x.astype(float) for x in P.unflat(flat))
        h = np.tanh(b + sum(emb[j][around[j, i]] for j in range(4)))
        zc, zw = h @ wc + bc, h @ ww[words[i] % P.CLASSES] + bw[words[i] % P.CLASSES]
        return zc[words[i] % P.CLASSES] - np.log(np.exp(zc).sum()) + zw[words[i] // P.CLASSES] - np.log(np.exp(zw).sum())

    got = P.log_probabilities(P.unflat(flat), around, words)
    assert np.allclose(got, [plain(flat, i) for i in range(30)], atol=1e-4)
    assert (around[:, 0] == [P.SIZE, P.SIZE, words[1], words[2]]).all() and (around[:, 12] == [P.SIZE, P.SIZE, words[13], words[14]]).all()
    _, gx, g_wc, g_bc, g_ww, g_bw = P.Trainer(flat).gradients(around, words)
    loss = lambda f: -np.mean([plain(f, i) for i in range(30)])
    starts = np.cumsum([0] + [int(np.prod(x)) for x in P.SHAPES])
    for k, g in ((1, gx.sum(axis=0)), (2, g_wc), (3, g_bc), (4, g_ww), (5, g_bw)):
        for at in np.argsort(-np.abs(g.ravel()))[:3]:
            up, down = flat.astype(float), flat.astype(float)
            up[starts[k] + at] += 1e-4
            down[starts[k] + at] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - g.ravel()[at]) < 1e-3


def test_pseudo_likelihood_steps_equal_plain_loops():
    """One step of the trainer against loops over words, with repeated words and pads; contexts of some words; scores too large for e**x."""
    P = pseudolikelihood
    rng = np.random.default_rng(5)
    flat = (P.start(rng.integers(0, 50, P.SIZE)) + rng.standard_normal(len(P.start(np.ones(P.SIZE)))) * 0.1).astype(np.float32)
    words = rng.integers(0, 6, 40).astype(np.int16) * 700
    offsets = np.array([0, 1, 1, 20, 40])
    around, pick = P.contexts(words, offsets), rng.permutation(40)
    for i, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
        for p in range(lo, hi):
            assert around[:, p].tolist() == [words[p + r] if lo <= p + r < hi else P.SIZE for r in P.REACH]
    assert (P.contexts(words, offsets, pick) == around[:, pick]).all()
    trainer = P.Trainer(flat)
    own, gx, *rest = (x.astype(float) for x in trainer.gradients(around, words))
    trainer.train(around, words)
    want = [x.astype(float) for x in P.unflat(flat)]
    for j in range(4):
        for v in set(own[j].astype(int)) - {P.SIZE}:
            g = gx[own[j] == v].sum(axis=0)
            want[0][j, v] -= P.STEP * g / np.sqrt(1e-3 + (g * g).sum() / P.HIDDEN)
    for x, g in zip(want[1:], (gx.sum(axis=0), *rest)):
        x -= P.STEP * 0.2 * g / np.sqrt(1e-3 + g * g)
    assert all(np.allclose(x, y, atol=1e-5) for x, y in zip(P.unflat(trainer.flat), want))
    huge = P.unflat(flat * np.float32(1e3))
    assert np.isfinite(P.log_probabilities(huge, around, words)).all() and np.isfinite(P.log_probabilities(P.unflat(-flat * np.float32(1e3)), around, words)).all()


def test_pseudo_likelihood_sums_by_row_equal_plain_loops():
    """Rows that windows use once, a few times and often, also in one window alone."""
    P = pseudolikelihood
    rng = np.random.default_rng(9)
    for n, words in ((1, 3), (2, 1), (300, 2), (300, 90), (300, P.SIZE + 1)):
        around = np.where(rng.random((4, n)) < 0.2, P.SIZE, rng.integers(0, words, (4, n)))
        gx = rng.standard_normal((n, P.HIDDEN)).astype(np.float32)
        want = {}
        for j in range(4):
            for i in range(n):
                row = j * (P.SIZE + 1) + around[j, i]
                want[row] = want.get(row, 0) + gx[i].astype(float)
        rows, g = P.sums_by_row(P._rows(around), gx)
        assert sorted(rows.tolist()) == sorted(want) and all(np.allclose(g[k], want[r], atol=1e-4) for k, r in enumerate(rows.tolist()))


def test_pseudo_likelihood_scores_in_small_parts(monkeypatch):
    """Scores don't depend on how many windows are scored at once, and what they hold at once is small."""
    P = pseudolikelihood
    rng = np.random.default_rng(10)
    flat = (P.start(rng.integers(0, 50, P.SIZE)) + rng.standard_normal(len(P.start(np.ones(P.SIZE)))) * 0.1).astype(np.float32)
    w = P.Weights(P.unflat(flat))
    words = rng.zipf(1.3, 1 << 14).clip(max=P.SIZE) - 1
    around = P.contexts(words.astype(np.int32), np.array([0, 5, 5, len(words)]))
    tracemalloc.start()
    got = P.log_probabilities(w, around, words)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6e6
    for block, part in ((1 << 14, 7), (50, 1 << 11), (1 << 14, 1 << 14)):
        monkeypatch.setattr(P, "BLOCK", block)
        monkeypatch.setattr(P, "PART", part)
        assert np.allclose(P.log_probabilities(w, around, words), got, atol=1e-4)


def test_pseudo_likelihood_beats_frequencies(spark):
    rng = random.Random(4)
    texts = [" ".join(f"a{(s + j) % 40}" for j in range(60)) for s in (rng.randrange(40) for _ in range(300))]
    docs = frame(spark, list(enumerate(texts)) + [(900, None), (901, "")])
    got = {r["doc_id"]: r for r in pseudolikelihood.score(docs, rounds=16).collect()}
    mean = sum(r["pll"] for r in got.values()) / sum(r["n_words"] for r in got.values())
    assert mean > -np.log(40) + 0.5 and got[900]["pll"] == 0 == got[901]["n_words"]
    flat = pseudolikelihood.start(np.ones(pseudolikelihood.SIZE))
    around = np.zeros((4, pseudolikelihood.SIZE), np.int32)
    p = pseudolikelihood.log_probabilities(pseudolikelihood.unflat(flat), around, np.arange(pseudolikelihood.SIZE))
    assert abs(np.exp(p).sum() - 1) < 1e-3


def test_pseudo_likelihood_learns_from_every_window_in_production_rounds(spark):
    rng = random.Random(4)
    texts = [" ".join(f"a{(s + j) % 40}" for j in range(60)) for s in (rng.randrange(40) for _ in range(1500))]
    got = pseudolikelihood.score(frame(spark, list(enumerate(texts))).repartition(2)).collect()
    assert sum(r["pll"] for r in got) / sum(r["n_words"] for r in got) > -np.log(40) + 0.5


def test_pseudo_likelihood_by_join_equals_counts_at_hand(spark, monkeypatch):
    rng = random.Random(14)
    top = " ".join(f"t{i} t{i} t{i}" for i in range(pseudolikelihood.TOP))
    docs = frame(spark, [(0, top)] + [(i, " ".join(f"r{rng.randrange(300)}" for _ in range(rng.randrange(1, 40)))) for i in range(1, 40)] + [(1, None), (None, "r1 r1"), (None, "r1 r1")])
    made = []
    for cached in (1 << 18, 5):
        monkeypatch.setattr(pseudolikelihood, "CACHED", cached)
        made.append(sorted((r["doc_id"] or 0, r["n_words"], round(r["pll"], 4)) for r in pseudolikelihood.score(docs.coalesce(1)).collect()))
    assert made[0] == made[1] and len(made[0]) == 43
    assert pseudolikelihood.score(docs.limit(0)).count() == 0


def test_pseudo_likelihood_tells_words_of_one_slot_apart(spark):
    names = [f"rare{i}" for i in range(600)]
    slots = pseudolikelihood.Vocabulary(np.zeros(0, np.uint64)).ids(K.words(pa.array([" ".join(names)])).hashes)
    one, two = next((names[i], names[j]) for j in range(600) for i in range(j) if slots[i] == slots[j])
    top = " ".join(f"t{i} t{i} t{i} t{i}" for i in range(pseudolikelihood.TOP))
    docs = frame(spark, [(1, top), (2, one), (3, one), (4, one), (5, two), (None, None), (8, "")])
    got = {r["doc_id"]: r["pll"] for r in pseudolikelihood.score(docs).collect()}
    assert got[2] == got[3] and abs(got[2] - got[5] - np.log(3)) < 1e-6
    assert len(got) == 7 and got[None] == got[8] == 0


def test_warc_round_trip_and_determinism(spark, tmp_path):
    rows = [(i, f"http://h{i % 7}.example.org/{i}", f"<p>{'é' * (i % 50)}</p>") for i in range(200)] + [(None, None, None), (3, "http://h3.example.org/3", "<p>ééé</p>"), (4, "nonsense", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = []
    for name, n in (("a", 1), ("b", 5)):
        index = warc.write(pages.repartition(n), f"file://{tmp_path}/{name}", max_bytes=4000, range_rows=40)
        assert index.count() == len(rows)
        made.append({p.name: p.read_bytes() for p in (tmp_path / name).iterdir()})
    assert made[0] == made[1] and len(made[0]) > 3
    found = []
    for name, data in made[0].items():
        if name.endswith(".gz"):
            for head, block in warc.read(data):
                assert warc.digest(block) == head["WARC-Block-Digest"]
                if head["WARC-Type"] == "response":
                    body = block.partition(b"\r\n\r\n")[2]
                    assert warc.digest(body) == head["WARC-Payload-Digest"]
                    found.append((head["WARC-Target-URI"], body.decode()))
    assert sorted(found) == sorted((u or "", h or "") for _, u, h in rows)


def test_warc_equals_plain_writer(spark, tmp_path):
    """One file per range, written by a plain loop; a second attempt replaces files; long pages roll."""
    rng = random.Random(7)
    rows = [(i, f"http://{'ab'[i % 2]}.example.org/{rng.randrange(50)}", prose(rng, rng.choice([3, 2000]))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    folder = f"file://{tmp_path}/w"
    index = {r["page_id"]: (r["file"], r["position"], r["length"]) for r in warc.write(pages, folder, max_bytes=3000).collect()}
    key = lambda r: ((r[1].split("/")[2] + " " + r[1]).encode(), r[0])
    n, data, want, files = 0, b"", {}, {}
    for i, url, html in sorted(rows, key=key):
        name = f"part-000000-{n:05d}.warc.gz"
        data = data or warc.member(warc.info(name))
        own = warc.member(warc.record(i, url, html)[0])
        want[i], data = (name, len(data), len(own)), data + own
        files[name] = data
        if len(data) >= 3000:
            n, data = n + 1, b""
    assert index == want
    made = {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")}
    assert made == files
    warc.write(pages, folder, max_bytes=3000)
    assert {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir() if p.name.endswith(".gz")} == files
    assert warc.write(pages.limit(0), f"file://{tmp_path}/none").count() == 0 and (tmp_path / "none" / "manifest.json").exists()


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 40))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan")] * 40)]
    got = {}
    for r in nearest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"]))
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 300
    for i in range(300):
        assert [n for _, n in sorted(got[i])] == sorted(range(300), key=lambda j: (d[i, j], j))[:5]


def test_nearest_edges(spark):
    rng = np.random.default_rng(2)
    big = [(rng.standard_normal(20) * 1e20).tolist() for _ in range(30)]
    table = lambda rows: spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, distance string")
    got = nearest.neighbours(table(list(enumerate(big)) + [(None, big[3])]), 3).collect()
    assert len(got) == 31 * 3 and {(r["neighbour_id"], r["distance"]) for r in got if r["vec_id"] == 3 and r["rank"] == 1} == {(None, 0.0)}
    x = np.array(big)
    for i in (0, 7, 29):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = [j for j in np.argsort(d, kind="stable") if j != i][:3]
        assert [r["neighbour_id"] for r in sorted((r for r in got if r["vec_id"] == i), key=lambda r: r["rank"]) if r["neighbour_id"] is not None][:2] == want[:2] or i == 3
    few = nearest.neighbours(table([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (2, [3.0, 4.0])]), 5).collect()
    assert sorted((r["vec_id"], r["rank"], r["neighbour_id"], r["distance"]) for r in few) == [(1, 1, 2, 5.0), (1, 2, 2, 5.0), (2, 1, 2, 0.0), (2, 1, 2, 0.0), (2, 2, 1, 5.0), (2, 2, 1, 5.0)]
    assert nearest.neighbours(table([])).count() == 0 and nearest.neighbours(table([(1, [1.0])])).count() == 0


def test_nearest_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 48)) * 4
    x = (centre[rng.integers(0, 6, 700)] + rng.standard_normal((700, 48))).astype(np.float32)
    monkeypatch.setattr(nearest, "DATA_ROWS", 150)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in nearest.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"]))
    d = ((x.astype(float)[:, None] - x.astype(float)[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for i in range(700):
        assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(700), d[i]))[:10].tolist()


def test_nearest_of_some_rows_against_all(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (700, 6)).astype(float)  # many ties
    monkeypatch.setattr(nearest, "DATA_ROWS", 40)
    rows = [(i - 100, v.tolist()) for i, v in enumerate(x)] + [(None, x[3].tolist()), (0, x[5].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    key = lambda r: tuple((v is None, v or 0) for v in r)
    every = [tuple(r) for r in nearest.neighbours(table, 10).collect()]
    some = [tuple(r) for r in nearest.neighbours(table, 10, every=50).collect()]
    assert sorted(some, key=key) == sorted((r for r in every if r[0] is not None and r[0] % 50 == 0), key=key)
    assert len(some) == 15 * 10 and len(every) == 702 * 10
    assert nearest.neighbours(table.filter("vec_id % 50 = 1"), 10, every=50).count() == 0 and nearest.neighbours(table.limit(0), every=50).count() == 0


def test_templates(spark):
    render = templates.compile_template("{% set a = 'x' ~ (1 + 2) %}{{ a|upper }}{% for m in messages -%}  {{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% generation %}{{ m['content'] }}{% endgeneration %}{% endfor %}{{ nothing.here }}")
    assert render({"messages": [{"role": "u", "content": "hi"}, {"role": "a", "content": None}]}) == ("X31u,hi2a", [(5, 7), (9, 9)])
    folded = templates.fold_block(templates.Parser("a{{ 1 + 2 }}{% if 1 > 2 %}no{% else %}b{% endif %}").parse())
    assert folded == (templates.Text("a3b"),)
    for bad in ("{% for x in %}", "{{ a.b( }}", "{% if x %}", "{{ x|nofilter }}", "{% import os %}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad)
    assert templates.compile_template("{{ x.__class__ }}")({"x": "s"})[0] == ""
    turns = spark.createDataFrame([(1, 1, "assistant", "yes"), (1, 0, "user", "q"), (2, 0, None, None), (None, None, "user", "")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in templates.render_conversations(turns).collect()}
    assert got[1]["rendered"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n" and got[1]["generated_chars"] == 13
    assert got[2]["n_generated"] == 0 and None in got


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{{ messages[1:][0].role }}{{ messages[:-1]|length }}{{ 'abc'[::-1] }}", "a1cba"),
        ("{{ x is defined }}{{ messages is defined }}{{ messages[0].content is none }}{{ messages[0].role is string }}{{ x is not defined }}", "falsetruefalsetruetrue"),
        ("{{ {'a': [1, true]}|tojson }}{{ '}}' }}{{ \" hi \".strip() }}", '{"a": [1, true]}}}hi'),
        ("{% set ns = namespace(n=0) %}{% for m in messages %}{% set ns.n = ns.n + 1 %}{% endfor %}{{ ns.n }}", "2"),
        ("{% for m in messages if m.role == 'a' %}{{ loop.length }}{{ m.content }}{% endfor %}", "1yo"),
        ("{% for m in messages %}{% set x = (x or '') ~ m.role %}{{ x }}{% endfor %}{{ x }}", "ua"),
        ("{% macro f(a, b='!') %}<{{ a }}{{ b }}>{% endmacro %}{{ f('x') }}{{ f('y', b='?') }}", "<x!><y?>"),
        ("{% for i in range(5) %}{% if i == 1 %}{% continue %}{% endif %}{% if i == 3 %}{% break %}{% endif %}{{ i }}{% endfor %}", "02"),
        ("{{ (messages|selectattr('role', 'equalto', 'u')|list)[0].content }}{{ 'a,b'.split(',')|join('-') }}{{ 7 / 2 }}", "hia-b3.5"),
        ("{% for k, v in {'p': 1, 'q': 2}.items() %}{{ k }}{{ v }}{% endfor %}", "p1q2"),
    ],
)
def test_template_language(source, want):
    env = {"messages": [{"role": "u", "content": "hi"}, {"role": "a", "content": "yo"}]}
    assert templates.compile_template(source)(env)[0] == want


def test_template_errors_are_rows(spark):
    rows = [(1, None, "u", "a"), (2, 3, "u", "b"), (2, 3, "u", "b"), (3, 0, "x", "c " * 200_000), (4, 5, "stop", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit("clash"))
    source = "{% for m in messages %}{% if m.role == 'stop' %}{{ raise_exception('no ' ~ m.role) }}{% endif %}{% if m.turn < 9 %}{{ m.content }}{% endif %}{% endfor %}"
    got = {r["conv_id"]: r for r in templates.render_conversations(turns, source).collect()}
    assert got[1]["rendered"] is None and "compared" in got[1]["error"] and got[4]["error"] == "no stop"
    assert got[2]["rendered"] == "bb" and got[3]["rendered"] == "c " * 200_000 and got[3]["error"] is None
    assert templates.render_conversations(turns.limit(0)).count() == 0
    for bad in ("{{ f( }}", "{% for x y in z %}{% endfor %}", "{{ a is odd }}", "{% macro 3() %}{% endmacro %}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad)
    for odd in ("{{ x.__class__() }}", "{{ 'a'.format(1) }}", "{% break %}", "{% macro f() %}{{ f() }}{% endmacro %}{{ f() }}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(odd)({"x": "s"})


def test_reputation_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.b.co.uk/x"), (2, None), (3, "junk"), (4, "https://u@H.example.com:80/"), (5, "http://10.0.0.1/")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r["page_id"]: (r["host"], r["domain"], r["suffix"]) for r in reputation.scored(pages, labels).collect()}
    assert got == {1: ("a.b.co.uk", "b.co.uk", "co.uk"), 2: ("", "", ""), 3: ("", "", ""), 4: ("h.example.com", "example.com", "com"), 5: ("10.0.0.1", "10.0.0.1", "")}
    assert reputation.scored(pages, labels.limit(0)).filter("keep").count() == 0
    assert reputation.scored(pages.limit(0), labels).count() == 0 == reputation.keep_reputable(pages.limit(0), labels).count()
    odd = pages.union(pages).union(spark.createDataFrame([(6, "http://[2001:db8::1]:80/x"), (7, "http://a.b.or.jp/"), (8, "https://" + "x" * 5000 + ".com/")], pages.schema)).withColumn("host", F.lit("clash"))
    more = {r["page_id"]: r for r in reputation.scored(odd, labels, second_level=("or",)).collect()}
    assert (more[6]["host"], more[6]["domain"], more[6]["suffix"]) == ("[2001:db8::1]", "[2001:db8::1]", "") and more[7]["domain"] == "b.or.jp" and more[1]["n_labelled"] == 1
    best = spark.createDataFrame([(i, f"http://good.com/{i}") for i in range(60)] + [(100 + i, f"http://bad.com/{i}") for i in range(60)], "page_id long, url string").withColumn("kept_host", F.lit("clash"))
    marks = spark.createDataFrame([(i, int(i < 100)) for i in [*range(60), *range(100, 160)]], "doc_id long, quality int")
    kept = reputation.keep_reputable(best, marks)
    assert kept.columns == best.columns and {r["page_id"] for r in kept.collect()} == set(range(60))
