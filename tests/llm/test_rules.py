"""Quality rules, n-gram join, chat formatting, mixing, search, language and toxicity."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import make, odd_rows, sentence
from pyspark.sql import functions as F

from fieldledger.llm import chat, language, mixing, ngramjoin, quality, registry, topk, toxicity
from fieldledger.llm.common import held_out_id

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base_of(text):
    text = text or ""
    w = SPACE.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def verdicts(rows, max_docs=quality.MAX_LINE_DOCS, max_share=quality.MAX_LINE_SHARE):
    """(words_removed, kept) by brute force: the distinct texts of each line of a host."""
    lines_of = []
    for r in rows:
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip() for x in (r[1] or "").split("\n")]
        lines_of.append([x for x in norm if x])
    seen, hosts = defaultdict(set), Counter(r[2] or "" for r in rows)
    for r, lines in zip(rows, lines_of, strict=True):
        for line in lines:
            seen[r[2] or "", line].add(r[1])
    out = []
    for r, lines in zip(rows, lines_of, strict=True):
        host = r[2] or ""
        n, _, _, _, rep = base_of(r[1])
        gone = sum(len(x.split(" ")) for x in lines if len(seen[host, x]) > max_docs and len(seen[host, x]) > hosts[host] * max_share)
        depleted = gone > 0 and (n - gone < quality.MIN_WORDS_LEFT or 100 * (n - gone) < quality.MIN_PERCENT_LEFT * n)
        out.append((r[0], gone, not (n < 20 or 100 * rep > 30 * n) and not depleted))
    return out


def judged(docs):
    return sorted(((r["doc_id"], r["words_removed"], r["kept"]) for r in quality.quality_rules(docs).collect()), key=repr)


def test_base_rules(spark):
    rows = [(*r, "s") for r in [*odd_rows(), (20, "a b c d e f g h i " * 9), (21, "l1 x\nl1 x\n\n \nl1 x # $"), (22, "one two\x0bthree\x0cfour\r\nfive")]]
    got = {r["doc_id"]: r for r in quality.quality_rules(make(spark, rows)).collect()}
    for i, text, _ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_of(text)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])


def test_line_frequency(spark):
    menu = "home about contact 2024 privacy terms of use and more links for everyone to read"
    rows = [(i, f"{menu}\n{sentence(i + 50, 60)}", "a") for i in range(40)]  # own text and a menu
    rows += [(100 + i, "\n".join([menu] * (2 + i)), "a") for i in range(3)]  # a menu only
    rows += [(200 + i, "\n".join(sentence(900 + k, 12) for k in range(12)), "a") for i in range(60)]  # a page of many copies
    rows += [(300, f"{menu}\nextra words", "b"), (301, None, None), (None, f"{menu}\n{sentence(7, 60)}", "a"), (None, sentence(8, 60), None), (5, sentence(9, 60), "a")]
    docs = make(spark, rows)
    assert judged(docs) == sorted(verdicts(rows), key=repr)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    want = [(r[0], r[1].removeprefix(menu + "\n") if r[2] == "a" else r[1]) for r, (_, _, ok) in zip(rows, verdicts(rows), strict=True) if ok]
    assert got == sorted(want, key=repr)
    assert quality.quality_rules(docs.limit(0)).count() == 0 and quality.keep_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("shared, own", [(3, 1), (10, 3), (10, 8), (30, 3)])
def test_boilerplate_of_several_lines(spark, shared, own):
    """Lines that come together are each counted in full, however few lines a document has beside them."""
    footer = [sentence(700 + k, 8) for k in range(shared)]
    rows = [(i, "\n".join([*(sentence(1000 + 50 * i + k, 9) for k in range(own)), *footer]), "a") for i in range(400)]
    assert judged(make(spark, rows)) == sorted(verdicts(rows), key=repr)
    assert {r[1] for r in verdicts(rows)} == {8 * shared}


def test_limits_are_exclusive(spark):
    rows = [(i, f"the same line in each of them\n{sentence(i, 40)}", "a") for i in range(quality.MAX_LINE_DOCS)]
    assert {x[1] for x in judged(make(spark, rows))} == {0}


CLASHING = ("row", "doc", "key", "gone", "kept", "line", "host", "hi", "rep", "class_row", "label", "score", "terms", "tokens", "draw", "block", "weight", "plan_source")


def clashing(spark, rows):
    """Documents with further columns named like those that the operators use."""
    docs = make(spark, rows)
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


def test_rows_of_one_id_are_told_apart(spark):
    """Null and repeated ids, and further columns of clashing names, through every stage that returns documents."""
    x, y, z = sentence(1, 80), sentence(2, 80), sentence(3, 80)
    rows = [(1, x), (5, x), (5, y), (None, x), (None, z), (None, z), (5, y)]
    docs = clashing(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")

    def told(df):
        assert df.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    assert told(quality.keep_documents(docs)) == sorted(rows, key=repr) == told(toxicity.drop_toxic(docs, none))
    assert told(ngramjoin.one_of_each(docs)) == sorted([(1, x), (5, y), (None, z)], key=repr)
    assert told(mixing.mix(docs).select(*docs.columns)) == sorted(rows, key=repr)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngramjoin.similarity_join(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 2), (5, 1, 2), (None, 1, 2), (5, 5, 1), (5, 5, 1), (None, None, 1), (None, None, 1)], key=repr)


def jaccard_groups(rows, least=0.8):
    sets = {}
    for k, r in enumerate(rows):
        w = (r[1] or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    links, up = Counter(), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in sets:
        groups[root(i)].append(i)
    ids = {i: min(rows[j][0] for j in g) for g in groups.values() for i in g}
    return sorted((rows[i][0], ids[i], links[i]) for i in sets)


def near_rows():
    rows = list(odd_rows())
    base = sentence(70, 150).split()
    for i in range(90):  # a cluster beyond one bucket
        w = list(base)
        w[(i * 7) % 150] = f"c{i}"
        rows.append((1000 + i, " ".join(w)))
    return rows + [(3000 + i, sentence(70, 60) + " " + sentence(200 + i, 90)) for i in range(80)]  # one passage in common


def test_ngram_join(spark):
    rows = near_rows()
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngramjoin.similarity_join(make(spark, rows)).collect())
    assert got == jaccard_groups(rows)
    one = ngramjoin.one_of_each(make(spark, rows))
    assert one.columns == make(spark, rows).columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, c, _ in got})
    assert ngramjoin.similarity_join(make(spark, rows).limit(0)).count() == 0


def test_large_buckets_are_settled_or_split(spark, monkeypatch):
    """A bucket of near copies is one group at once; one of documents that share a passage splits until it is small."""
    monkeypatch.setattr(ngramjoin, "BUCKET", 8)
    rows = near_rows()
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngramjoin.similarity_join(make(spark, rows)).collect())
    assert got == jaccard_groups(rows)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest ones: 19 in 20 are met at least (in fact nearly all)."""
    rows = []
    for i in range(300):
        w = sentence(10_000 + i, 150).split()
        rows.append((2 * i, " ".join(w)))
        for at in (20, 60, 100):  # each changes five shingles of 146: 131 / 161 = 0.81
            w[at] = f"z{i}x{at}"
        rows.append((2 * i + 1, " ".join(w)))
    want = jaccard_groups(rows)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngramjoin.similarity_join(make(spark, rows)).collect())
    assert sum(w[2] for w in want) == 600 and sum(g[2] for g in got) >= 0.95 * 600
    assert all(g in want for g in got if g[2])


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    rows = near_rows()
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngramjoin.similarity_join(make(spark, rows)).collect())
    assert got == jaccard_groups(rows)


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>user", "back\\slash \\<| <\\|", "ends in <", "", None, "日本 \U0001f600\n"]
    rows = [("t", k, k - 1 if k else None, r, x, 1.0) for k, (r, x) in enumerate(zip(["user", "assistant", "assi\nstant", "assistant", None, "user", "<|"], texts, strict=True))]
    rows += [("t", 20, 1, "assistant", "other branch", 9.0), ("u", 0, None, "assistant", "alone", None), ("v", 1, 7, "user", "orphan", 0.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in chat.format_trees(nodes, branches=2).select("tree", "leaf", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    assert set(got) == {("t", 6), ("t", 20), ("u", 0), ("v", 1)}
    chain = [(r or "", x or "") for _, _, _, r, x, _ in rows[:7]]
    assert [tuple(x) for x in got["t", 6]["turns"]] == chain
    assert got["t", 6]["loss"] == "".join(x for r, x in chain if r == "assistant")
    assert [x["text"] for x in got["t", 20]["turns"]] == ["plain", texts[1], "other branch"]
    best = chat.choose_branches(chat.root_paths(nodes), nodes).select("tree", "leaf").distinct().collect()
    assert {tuple(r) for r in best} == {("t", 20), ("u", 0), ("v", 1)}


def test_chat_rings_and_empty(spark):
    schema = "tree string, node long, parent long, role string, text string, score double"
    ring = spark.createDataFrame([("r", 0, 1, "user", "a", 0.0), ("r", 1, 0, "user", "b", 0.0)], schema)
    assert chat.format_trees(ring).count() == 0 and chat.format_trees(ring.limit(0)).count() == 0


def test_mixing(spark):
    rows = [(i, sentence(i, 10), "big") for i in range(900)] + [(1000 + i, sentence(i, 10), "mid") for i in range(90)] + [(2000 + i, sentence(i, 10), None) for i in range(10)] + [(3000, None, "void")]
    docs = make(spark, rows)
    out = mixing.mix(docs, target=0.6, max_repeats=4.0).collect()
    times = Counter(r["doc_id"] for r in out)
    assert set(times) == {r[0] for r in rows}  # the default budget leaves no document out
    assert max(times.values()) <= 4 and {times[i] for i in range(900)} == {1}
    tokens = Counter()
    for r in out:
        tokens[r["source"]] += len((r["text"] or "").split())
    weight = {r["source"]: r["mix_weight"] for r in out}
    total = sum(tokens.values())
    for s in ("big", "mid", None):
        assert abs(tokens[s] / total - weight[s]) < 0.02
    assert all(0 <= r["mix_place"] <= 1 for r in out)
    less = mixing.mix(docs, target=0.6, budget=2000.0).collect()
    assert abs(sum(len((r["text"] or "").split()) for r in less) - 2000) < 3 * 10
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [None, 7000.0])
def test_mixing_by_hand(spark, monkeypatch, budget):
    """Each document's uses, from quotas, epochs and the order of blocks worked out one by one; counts given in a column."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    rows = [(i, sentence(i, 3 + i % 9), "big") for i in range(500)] + [(1000 + i, sentence(i, 4), "mid") for i in range(70)] + [(2000, sentence(1, 5), None)]
    docs = make(spark, rows).withColumn("count", F.col("doc_id") % 7 + 1)
    out = mixing.mix(docs, tokens="count", target=0.7, budget=budget).collect()
    told = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("s"), "count", mixing.draw().alias("draw")).collect()
    tokens, n = Counter(), Counter()
    for r in told:
        tokens[r["s"]] += r["count"]
        n[r["s"]] += 1
    total = sum(tokens.values())
    heat = mixing.find_alpha(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), 0.7, mixing.MAX_REPEATS, budget)
    power = {s: (t / total) ** heat.alpha for s, t in tokens.items()}
    want = Counter()
    for s, t in tokens.items():
        quota = power[s] / sum(power.values()) * heat.budget
        epochs, blocks = math.floor(quota / t + 1e-6), math.ceil(n[s] / max(8, math.sqrt(n[s])))
        own = [r for r in told if r["s"] == s]
        order = spark.range(blocks).select("id", F.xxhash64(F.lit(s), F.lit(epochs), F.col("id"), F.lit(mixing.SEED)).alias("h")).orderBy("h", "id").collect()
        room = max(quota - epochs * t, 0.0)
        used = set()
        for b in (r["id"] for r in order):
            inside = sorted((r["draw"], r["doc_id"], r["count"]) for r in own if r["draw"] % blocks == b)
            if room <= 0:
                break
            for _, i, c in inside:
                room -= c
                if room < 0:
                    break
                used.add(i)
        for r in own:
            want[r["doc_id"]] = epochs + (r["doc_id"] in used)
    assert Counter(r["doc_id"] for r in out) == +want
    places = sorted((r["mix_place"], r["source"]) for r in out if r["source"] == "big")
    assert len({r["mix_epoch"] for r in out if r["doc_id"] == 2000}) == want[2000] and 0 <= places[0][0] <= places[-1][0] <= 1


def test_alpha_against_bisection(spark):
    tokens = [1000, 300, 50, 50, 7]
    sources = spark.createDataFrame([(str(i), n) for i, n in enumerate(tokens)], "source string, tokens long")
    p = np.array(tokens) / sum(tokens)

    def entropy(a):
        w = p**a / (p**a).sum()
        return -(w * np.log(w)).sum()

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= 0.8 * math.log(5) else (low, mid)
    assert abs(mixing.find_alpha(sources, 0.8, 1e9, None).alpha - low) < 1e-5
    tight = mixing.find_alpha(sources, 0.8, 2.0, None).alpha
    assert abs((1000 / 7) ** (1 - tight) - 2.0) < 1e-3


def best_by_hand(rows, queries, k=topk.K):
    """{query: [(doc, score)]} over all pairs."""
    bags = [(i, Counter(topk.words(t))) for i, t in rows if i is not None]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(w for _, b in bags for w in b)
    idf = {w: math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    asked, out = defaultdict(set), {}
    for q, text in queries:
        asked[q] |= {w for w in topk.words(text) if w in idf}
    for q, terms in asked.items():
        scores = []
        for i, b in bags:
            norm = topk.K1 * (1 - topk.B + topk.B * sum(b.values()) / mean)
            parts = [idf[w] * (b[w] * (topk.K1 + 1) / (b[w] + norm)) for w in terms if w in b]
            if parts:
                scores.append((i, round(math.fsum(parts), topk.PLACES)))
        if scores and q is not None:
            out[q] = sorted(scores, key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(docs, queries, **options):
    got = defaultdict(list)
    for r in topk.top_k(docs, queries, **options).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    return dict(got)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_TOKENS", 500)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "GROWTH", 3)
    vocabulary = sentence(5, 60).split()
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 80)))) for i in range(300)] + [(400, None), (401, ""), (402, str(rng.choice(vocabulary))), (None, vocabulary[0]), (7, vocabulary[1])]
    rows += [(500 + i, rows[3][1]) for i in range(15)]  # ties beyond k
    docs = make(spark, rows)
    queries = docs.filter("doc_id % 50 = 0 OR doc_id IN (3, 402) OR doc_id IS NULL").selectExpr("CASE WHEN doc_id = 402 THEN 3 ELSE doc_id END AS query_id", "text", "doc_id AS rank")
    want = best_by_hand(rows, [(r["query_id"], r["text"]) for r in queries.collect()])
    assert found(docs, queries) == want and len(want) == 8
    assert found(docs.limit(0), queries) == {} and found(docs, queries.limit(0)) == {}


def test_top_k_asks_for_all_words(spark):
    """A document that shares the 40 common words of a query beats one that has its 24 rare ones."""
    common, rare = [f"c{i}" for i in range(400)], [f"r{i}" for i in range(24)]
    rows = [(0, " ".join(common + rare)), (1, " ".join(rare)), (2, " ".join(common))] + [(3 + i, " ".join(common[i::40])) for i in range(40)] + [(50 + i, " ".join(rare)) for i in range(3)]
    docs = make(spark, rows)
    got = found(docs, docs.filter("doc_id = 0").selectExpr("doc_id AS query_id", "text"), k=2)
    assert got == best_by_hand(rows, rows[:1], k=2) and {i for i, _ in got[0]} == {0, 2}


def test_bounds_prune_and_lose_nothing():
    """Under the threshold of other shards most blocks are skipped; what is found is the same as without one."""
    docs = [(i, sentence(i % 4, 30) + " " + sentence(i, 20 + i % 50)) for i in range(2000)]
    shard = topk.Shard.build([i for i, _ in docs], [t for _, t in docs])
    searcher = topk.Searcher(shard, float(shard.lengths.mean()))
    terms = [np.array([searcher.where[w] for w in sorted(set(topk.words(docs[q][1])))]) for q in range(0, 2000, 50)]
    starts, flat = np.concatenate([[0], np.cumsum([len(t) for t in terms])]), np.concatenate(terms)
    idf = np.log(1 + (2000 - searcher.df + 0.5) / (searcher.df + 0.5))[flat]
    open_ = sorted(searcher.search(flat, idf, starts, 10, np.zeros(len(terms))))
    kth = np.array([sorted((s for q, _, s in open_ if q == i), reverse=True)[9] for i in range(len(terms))])
    searcher.scored = 0
    assert sorted(searcher.search(flat, idf, starts, 10, kth)) == open_
    assert searcher.scored < 0.8 * 2000 * len(terms)


def test_shards_are_small_and_come_back_whole():
    """A posting takes little more than a place and a count when stored, and few bytes of memory when it is searched."""
    docs = [(i, sentence(i, 60 + i % 50) + " and" * (i // 4)) for i in range(1500)]
    shard = topk.Shard.build([i for i, _ in docs], [t for _, t in docs])
    assert shard.tfs.max() > 255
    packed = shard.pack()
    words = len("\n".join(shard.terms.to_pylist() if isinstance(shard.terms, pa.Array) else shard.terms))
    assert sum(len(x) for x in packed) - words < 5 * len(shard.docs) + 12 * len(docs) + 8 * len(shard.terms)
    kinds = [pa.string() if isinstance(x, str) else pa.binary() for x in packed]
    again = topk.Shard.unpack(pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(packed, kinds, strict=True)], ["ids", "lengths", "terms", "dfs", "docs", "tfs", "more"]), 0)
    for name in ("ids", "lengths", "starts", "docs", "tfs"):
        assert (getattr(again, name) == getattr(shard, name)).all()
    assert again.terms.to_pylist() == shard.terms.to_pylist()
    searcher = topk.Searcher(again, float(shard.lengths.mean()))
    assert searcher.places(pa.array(["and", "nowhere"])).tolist() == [searcher.where["and"], -1]


def test_rounds_take_shards_of_many_tasks(spark):
    """The shards of a round lie in as many files as there are, and the few that are left join the last round."""
    index = spark.createDataFrame([((part << 20) + made,) for part in range(8) for made in range(3)], "shard long")
    rounds = topk._rounds(index)
    assert [len(r) for r in rounds] == [1, 7, 16] and {s >> 20 for s in rounds[1]} == set(range(1, 8))
    for own in rounds:
        assert sorted(r["shard"] for r in topk._some(index, own).collect()) == sorted(own)


def test_language_lengths_are_exact():
    """Code lengths from the table equal those of a plain walk down the context trees; each state's shares sum to one."""
    grams = Counter()
    for lang, text in ((0, "the cat and the hat"), (1, "der hut und die katze")):
        b = b"   " + language.fold(text)
        for i in range(3, len(b)):
            grams[lang, int.from_bytes(b[i - 3 : i + 1], "big")] += 1
    keys = sorted(grams)
    model = (("en", "de"), np.array([k[0] for k in keys], np.uint8).tobytes(), np.array([k[1] for k in keys], np.uint32).tobytes(), np.array([grams[k] for k in keys], np.uint32).tobytes())
    symbol, size, state, bits = language.tables(model)
    shares = np.exp2(-bits.reshape(-1, size, 2).astype(np.float64)).sum(1)
    assert np.allclose(shares, 1, atol=1e-4)

    def walk(lang, context, b):
        if context is None:
            return 1 / size
        own = Counter()
        for (k, g), n in grams.items():
            seq = [symbol[x] for x in g.to_bytes(4, "big")]
            if k == lang and seq[3 - len(context) : 3] == context:
                own[seq[3]] += n
        shorter = context[1:] if context else None
        if not own:
            return walk(lang, shorter, b)
        total, kinds = sum(own.values()), len(own)
        if b in own:
            return own[b] / (total + kinds)
        return kinds / (total + kinds) * walk(lang, shorter, b) / (1 - sum(walk(lang, shorter, x) for x in own))

    text = "the hut"
    seq = [symbol[x] for x in b"   " + language.fold(text)]
    want = [-sum(math.log2(walk(k, seq[i - 3 : i], seq[i])) for i in range(3, len(seq))) for k in (0, 1)]
    assert np.allclose(language.code_lengths(model, [text])[0], want, rtol=1e-4)


def test_code_lengths_do_not_depend_on_batches(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.learn(docs)
    texts = [r["text"] for r in docs.select("text").limit(50).collect()]
    whole = language.code_lengths(model, texts)
    monkeypatch.setattr(language, "SLICE", 97)
    assert np.allclose(language.code_lengths(model, texts), whole, rtol=1e-5)
    assert np.allclose(np.vstack([language.code_lengths(model, [t]) for t in texts]), whole, rtol=1e-5)


def test_language_held_out(spark):
    got = language.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(got) == len(docs) and all(r["held_out"] == held_out_id(r["doc_id"]) for r in got)
    held = [r["lang_pred"] == docs[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.97
    odd = make(spark, [(1, None), (2, ""), (3, "12 34 !! ½ ² ①"), (4, "the and of"), (4, "der und das"), (None, "the and of")])
    model = language.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, model).filter("doc_id < 4").orderBy("doc_id").collect()] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert {r["lang_pred"] for r in language.identify(odd, language.learn(odd.limit(0))).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0 and language.identify(odd, model).count() == 6


def test_toxicity_held_out(spark):
    got = toxicity.op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert sum(p for p, y in held if y) / sum(y for _, y in held) > 0.85
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_factorization_machine_learns_pairs():
    """Either term is harmless, both are not: no linear weights can say so without the pair."""
    rng = np.random.default_rng(5)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([x for x, on in ((11, a), (22, b), (33, True)) if on]))
        y.append(int(a and b))
    m = toxicity.fit(rows, np.array(y))
    where = {int(x): i for i, x in enumerate(m.ids)}
    score = lambda t: m.margin(np.array([where[x] for x in t if x in where], np.int64))
    assert score([11, 22]) > 0 > max(score([11]), score([22]), score([]))
    brute = m.bias + m.linear[[where[11], where[22]]].sum() + m.latent[where[11]] @ m.latent[where[22]]
    assert math.isclose(score([11, 22]), brute, rel_tol=1e-9)


def test_fit_against_single_steps(monkeypatch):
    """The gradient against differences of the loss, and the features against plain counting."""
    rng = np.random.default_rng(1)
    x = (rng.random((60, 5)) < 0.4).astype(np.float32)
    y, b, w, v = (rng.random(60) < 0.5).astype(np.float32), np.array([0.1]), rng.normal(size=5), rng.normal(size=(5, toxicity.FACTORS))

    def loss(b, w, v):
        pairs = [sum(v[i] @ v[j] for i in range(5) for j in range(i) if row[i] and row[j]) for row in x]
        m = b[0] + x @ w + np.array(pairs)
        return np.mean(np.log1p(np.exp(m)) - y * m) + 0.5e-5 * (w**2).sum() + 0.5e-4 * (v**2).sum()

    for k, got in enumerate(toxicity._gradient(x, y, b, w, v)):
        params = [b, w, v]
        for at in np.ndindex(params[k].shape):
            up, down = ([p.copy() for p in params] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(*up) - loss(*down)) / 2e-5 - got[at]) < 1e-4
    rows = [rng.choice(400, 20, replace=False) for _ in range(300)]
    labels = (rng.random(300) < 0.4).astype(np.int64)
    for i in np.flatnonzero(labels):
        rows[i] = np.unique(np.append(rows[i], 7))
    n = Counter(labels.tolist())
    strong = {}
    for t in range(400):
        c = [sum(t in r for r, l in zip(rows, labels, strict=True) if l == k) for k in (0, 1)]
        p = sum(c) / 300
        z = abs(c[1] / n[1] - c[0] / n[0]) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n[0] + 1 / n[1]))
        if z >= toxicity.LEAST_Z and sum(c) >= toxicity.LEAST_DOCS:
            strong[t] = z
    owners = np.repeat(np.arange(300), [len(r) for r in rows])
    assert toxicity.select_features(np.concatenate(rows), owners, labels).tolist() == sorted(strong, key=lambda t: (-strong[t], t))


def test_toxicity_odd_rows(spark):
    docs = make(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(odd_rows()) and not any(r["predicted"] for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.drop_toxic(docs.limit(0), none).count() == 0
    tie = toxicity.Model(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, toxicity.FACTORS)))
    twice = docs.unionByName(docs)
    assert {(r["score"], r["predicted"]) for r in toxicity.score(twice, tie).collect()} == {(0.5, 1)} and toxicity.score(twice, tie).count() == 2 * len(got)
    assert toxicity.score(clashing(spark, odd_rows()), tie).columns == ["doc_id", "held_out", "score", "predicted"]
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    with duckdb.connect() as db:
        for t in ("documents", "conversations"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        want = db.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, DATA).toPandas()
    names = sorted(want)
    assert names == sorted(got)
    assert got[names].sort_values(names).reset_index(drop=True).equals(want[names].sort_values(names).reset_index(drop=True))
