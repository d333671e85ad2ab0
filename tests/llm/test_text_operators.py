"""Kernels and queries of the corpus operators against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspark.llm import bottomk, decontam, html_density, mixing, pii, quality, simhash, suffix, tokens, toxicity
from terraspark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, fp long, spans string, words string, term string"
ODD = [None, "", " ", "\n\n", "a", "é", "x" * 5000, "word " * 3000, "The same text.", "The same text.", "1" * 400, "@.@", "<b>", "​", "漢字 漢字"]


def frame(spark, texts, ids=None, sources=None):
    ids = ids if ids is not None else list(range(len(texts)))
    sources = sources if sources is not None else ["s"] * len(texts)
    rows = [(i, t, "en", s, len(t or ""), 1, 2, "x", "y", "z") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    return frame(spark, [*ODD, ODD[-1], "tail"], [*range(len(ODD) - 1), 3, 3, None], [None, *["s"] * len(ODD), "t"])


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


# ---- op1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        ("plain", "plain"),
        ("<script>x</script>", ""),
        ("<nav><a href=/>menu</a></nav><article><h1>T</h1><p>One&nbsp;<b>bo</b>ld &amp; more text here.<p>Two</article><footer>f</footer>", "T One bold & more text here. Two"),
        ("<body><div class='ad-box'>buy buy buy</div><div id=content><p>The article text is long enough to be found.</p><p>And more.</p></div><section class='comments'><p>a reader says a lot of things here, longer than the article is itself, really</p></section>", "The article text is long enough to be found. And more."),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ],
)
def test_main_text(page, text):
    assert html_density.main_text(page) == text


def test_main_text_of_odd_pages():
    for page in ["<div>" * 3000 + "x", "<a \"" * 2000, "&amp;" * 1000, "<p>" * 5000, "<!-- " * 100, "</p>" * 1000, "<td>" * 500]:
        assert isinstance(html_density.main_text(page), str)


def test_pages_query(spark):
    df = spark.createDataFrame([(1, "u", "<p>a  b"), (1, "u", "<p>a  b"), (None, None, None)], "page_id long, url string, html string")
    assert sorted(html_density.extract_text(df).collect(), key=str) == [(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0)]
    assert html_density.extract_text(df.limit(0)).count() == 0


# ---- op2


def plain_spans(t):
    out = {k: [m.span() for m in re.finditer(p, t)] for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))}
    digits = lambda s: re.sub("[^0-9]", "", t[s[0] : s[1]])
    out["ip"] = [s for s in out["ip"] if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in t[s[0] : s[1]].split("."))]
    out["card"] = [s for s in out["card"] if 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s))]
    out["phone"] = [s for s in out["phone"] if 9 <= len(digits(s)) <= 15]
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    for _ in range(20000):
        t = "".join(rng.choice(["a", "@", "@", ".", ".", "1", "23", "4539 1488", "+", " ", "-", "b.c", "(", "255", "é", "300", "4785380592391139"]) for _ in range(rng.randint(0, 14)))
        assert plain_spans(t) == pii.find(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write to john at example dot com please", "email", "john at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("me@exam​ple.com", "email", "me@exam​ple.com"),
        ("call +1 five five five one two three four five six seven", "phone", "+1 five five five one two three four five six seven"),
        ("４７８５３８０５９２３９１１３９", "card", "４７８５３８０５９２３９１１３９"),
        ("192[.]168[.]1[.]1", "ip", "192[.]168[.]1[.]1"),
    ],
)
def test_disguises(text, kind, found):
    base = pii.find(text)
    spans = base[kind] + pii.find_added(text, base)[kind]
    assert [text[a:b] for a, b in spans] == [found]


def test_clean_texts_have_no_spans():
    for t in ["meet me at noon dot matrix", "I was at home one two three", "version 1.2.3", "the ou at of dot eren", *filter(None, ODD[:-2])]:
        base = pii.find(t)
        assert not any(base.values()) and not any(pii.find_added(t, base).values())


def test_mask_and_query(spark):
    df = frame(spark, ["x a@b.co y", None, "", "1.2.3.4"])
    rows = {r["doc_id"]: r for r in pii.mask_pii(df).collect()}
    assert rows[0]["text"] == "x <EMAIL> y" and rows[0]["n_chars"] == 11 and rows[1]["text"] is None and rows[3]["text"] == "<IP>"
    assert pii.mask_pii(df).columns == df.columns
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    assert got == {0: "email:2:8", 1: "", 2: "", 3: "ip:0:7"}
    assert pii.find_pii(df.limit(0)).count() == 0 and pii.find_pii(odd(spark)).count() == len(ODD) + 2


# ---- op3


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 300)) for _ in range(60)] + [None, "", "a b"]
    ids = rng.sample(range(-(10**12), 10**12), len(texts) - 1) + [2**62]
    got = {r["doc_id"]: r for r in bottomk.fingerprint_neighbours(spark, frame(spark, texts, ids)).collect()}
    order = sorted(zip(ids, texts), reverse=True)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        a, b, c = shingles(t), shingles(e), shingles(nxt)
        if len(a | b) <= 256:
            assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert abs(got[i]["near_next"] - (len(a & c) / len(a | c) if a | c else 1.0)) < 0.15


def test_fingerprints_odd_and_empty(spark):
    assert bottomk.fingerprint_neighbours(spark, odd(spark)).count() == len(ODD) + 2
    assert bottomk.fingerprint_neighbours(spark, odd(spark).limit(0)).count() == 0


def test_sketches_merge(spark):
    rng = random.Random(1)
    texts = [prose(rng, 200) for _ in range(8)]
    df = bottomk.with_sketch(frame(spark, texts).select("doc_id", "text", (F.col("doc_id") % 2).alias("g")), "text", "sk", 64)
    got = {r["g"]: r["sk"] for r in bottomk.merged(df, ["g"], "sk", 64).collect()}
    every = bottomk.with_sketch(frame(spark, texts), "text", "sk", 10**6).select("doc_id", "sk").collect()
    for g in (0, 1):
        assert got[g] == sorted({x for r in every if r["doc_id"] % 2 == g for x in r["sk"]})[:64]
    n = len(set().union(*map(shingles, texts[::2])))
    est = bottomk.merged(df, ["g"], "sk", 64).select(bottomk.distinct_shingles(F.col("sk"), 64).alias("n")).collect()
    assert any(abs(r["n"] / n - 1) < 0.4 for r in est)


# ---- op4, op5


def test_toxicity_and_quality_learn(spark):
    rng = random.Random(8)
    clean = [prose(rng, 80) for _ in range(150)]
    toxic = [f"{prose(rng, 30)} horrid {prose(rng, 20)} vermin {prose(rng, 30)}" for _ in range(150)]
    m = toxicity.train(clean[:120], toxic[:120])
    s = toxicity.Scorer(m)
    assert (s(toxic[120:]) >= 0.5).mean() > 0.9 and (s(clean[120:]) >= 0.5).mean() < 0.1
    bad = ["SPAM!! " * rng.randint(20, 60) + prose(rng, 5) for _ in range(100)]
    q = quality.Scorer(quality.train(bad[:80], clean[:80]))
    assert (q(clean[120:]) >= 0.5).mean() > 0.9 and (q(bad[80:]) >= 0.5).mean() < 0.1
    for scorer in (s, q):
        out = scorer([t or "" for t in ODD])
        assert ((out >= 0) & (out <= 1)).all() and len(scorer([])) == 0
    df = frame(spark, toxic[120:125] + clean[120:125] + [None])
    kept = toxicity.reject_toxic(df, m)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6, 7, 8, 9, 10}


def test_toxicity_learns_word_beginnings_of_a_small_language():
    rng = random.Random(9)
    other = lambda n: " ".join("".join(rng.choice("mnopqrstuv") for _ in range(rng.randint(1, 7))) for _ in range(n))
    rare = lambda: f"{other(25)} {' '.join('zwyxkl' + other(1) for _ in range(4))} {other(40)}"
    clean = [prose(rng, 80) for _ in range(900)] + [other(80) for _ in range(300)]
    toxic = [f"{prose(rng, 30)} horrid {prose(rng, 20)} vermin {prose(rng, 30)}" for _ in range(260)] + [rare() for _ in range(13)]
    s = toxicity.Scorer(toxicity.train(clean, toxic))
    assert (s([rare() for _ in range(40)]) >= 0.5).mean() > 0.8
    assert (s([other(80) for _ in range(40)] + [prose(rng, 80) for _ in range(40)]) >= 0.5).mean() < 0.1


def test_no_labels_give_a_constant(spark):
    labels = spark.createDataFrame([(1, None, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, ["a", "b"])
    m = toxicity.fit_toxicity(docs, labels, F.lit(True))
    assert {r["score"] for r in toxicity.score_toxicity(docs, m).collect()} == {1.0}
    q = quality.fit_quality(docs, labels, F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, q).collect()} == {0.0}


# ---- op6


def test_mixture_meets_its_budgets(spark):
    rng = random.Random(3)
    n = 900
    sources = ["hot"] * (n // 3) + [rng.choice(["a", "b", "c", None]) for _ in range(n - n // 3)]
    docs = frame(spark, [prose(rng, rng.randint(1, 60)) for _ in range(n)], sources=sources)
    out = mixing.mix(spark, docs, entropy_share=0.99, max_repeats=3.0, block_tokens=300).collect()
    size = Counter()
    for t, s in zip((r["text"] for r in docs.collect()), sources):
        size[s] += -(-len(t.encode()) // 4)
    src = spark.createDataFrame([(str(k), v) for k, v in size.items()], "key string, tokens long")
    m = mixing.fit_mixture(src, None, 0.99, 3.0)
    total = sum(size.values())
    z = sum((v / total) ** m.exponent for v in size.values())
    drawn, epochs = Counter(), Counter()
    for r in out:
        drawn[r["source"]] += r["tokens"]
        epochs[(r["doc_id"], r["epoch"])] += 1
    assert max(epochs.values()) == 1
    for s, v in size.items():
        budget = int((v / total) ** m.exponent / z * total)
        assert drawn[s] <= budget and budget - drawn[s] <= 110
    p = np.array([(v / total) ** m.exponent / z for v in size.values()])
    assert -(p * np.log(p)).sum() <= 0.99 * np.log(len(p)) + 1e-6


def test_mixture_odd_and_empty(spark):
    assert mixing.mix(spark, odd(spark).limit(0)).count() == 0
    assert mixing.mix(spark, odd(spark), entropy_share=None, max_repeats=None).count() >= 1


# ---- op7


def classes(v):
    i, j = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 3)
    c = simhash.Classes(len(v))
    c.add(i, j)
    return c.label


def ball(rng, n):
    base = rng.integers(0, 2**63, size=3, dtype=np.uint64)
    flips = [b ^ (np.uint64(1) << rng.integers(0, 64, size=n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, size=n, dtype=np.uint64)) for b in base]
    return np.unique(np.concatenate([rng.integers(0, 2**63, size=n, dtype=np.uint64), *flips]))


@pytest.mark.parametrize("node", [20000, 25])
def test_trie_join_by_brute_force(spark, node):
    v = ball(np.random.default_rng(5), 300)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    root = {r["node"]: r["root"] for r in connected_components(spark, simhash.trie_links(spark, df, node)).collect()}
    got = [root.get(int(x), int(x)) for x in v.view(np.int64)]
    want = classes(v)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_fingerprint_definition():
    import xxhash

    for t in ["", "A b", "One two THREE four\tfive\x0bsix", "é É ß " * 9]:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    root = {r["node"]: r["root"] for r in connected_components(spark, df).collect()}
    assert len({root[i] for i in range(201)}) == 1 and len({root[1000 + i] for i in range(200)}) == 1 and root[0] != root[1000]
    assert connected_components(spark, df.limit(0)).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    texts = [prose(rng, 200) for _ in range(30)]
    texts += [t + " z" for t in texts[:5]] + [texts[7]] * 20 + [None, ""]
    df = frame(spark, texts)
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(spark, df).collect()}
    label = classes(np.array([simhash.fingerprint(t or "") for t in texts], dtype=np.uint64))
    assert got == {i: int(k) for i, k in enumerate(label)}
    assert simhash.near_duplicates(spark, odd(spark)).count() == len(ODD) + 2
    assert simhash.near_duplicates(spark, df.limit(0)).count() == 0


# ---- op8


def cut_by_hand(texts, n=200):
    c = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        m = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                m[i] += 1
                m[i + n] -= 1
        cov = np.cumsum(m)[:-1] > 0
        out.append((len(b), int(cov.sum()), int(np.count_nonzero(np.diff(np.r_[0, cov.astype(int)]) == 1)), bytes(np.frombuffer(b, np.uint8)[~cov])))
    return out


@pytest.mark.parametrize("shard", [2000, 5])
def test_repeats_by_brute_force(spark, shard):
    rng = random.Random(shard)
    line = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    p = [line(rng.randint(150, 500)) for _ in range(6)]
    texts = ["".join(rng.choice([line(rng.randint(0, 300)), rng.choice(p), rng.choice(p)[: rng.randint(100, 400)], "a" * rng.randint(0, 500), "ab" * rng.randint(0, 200), "é" * 150]) for _ in range(rng.randint(0, 6))) for _ in range(150)]
    texts += texts[:5] + ["", None]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.remove_repeats(spark, frame(spark, texts), shard=shard).collect()}
    assert [got[i] for i in range(len(texts))] == cut_by_hand([(t or "").encode() for t in texts])


def test_repeats_odd_and_empty(spark):
    assert suffix.remove_repeats(spark, odd(spark)).count() == len(ODD) + 2
    assert suffix.remove_repeats(spark, odd(spark).limit(0)).count() == 0


# ---- op9


def contaminated(texts, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ph = {}
    for k, t in items:
        w = low(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            ph.setdefault(tuple(w[i : i + 10]), set()).add(k)
    out = {}
    for i, t in enumerate(texts):
        w, hit, found = low(t), set(), set()
        for n in {len(x) for x in ph}:
            for j in range(len(w) - n + 1):
                if k := ph.get(tuple(w[j : j + n])):
                    hit |= set(range(j, j + n))
                    found |= k
        out[i] = (len(w), len(hit), sorted(map(str, found)))
    return out


def test_contamination_by_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    items = [(k, prose(rng, rng.choice([0, 1, 3, 9, 10, 25]))) for k in range(12)] + [(99, None)]
    items[3] = (3, "the the the the the the the the the the the the")
    texts = []
    for _ in range(80):
        w = prose(rng, rng.randint(0, 60)).split() + ["the"] * rng.choice([0, 30])
        for _ in range(rng.randint(0, 2)):
            w[rng.randint(0, len(w)) : 0] = (rng.choice(items)[1] or "").upper().split()
        texts.append(rng.choice([" ", ", ", "\n"]).join(w))
    texts += [None, "", "É!"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = contaminated(texts, items)
    for bound in (200_000, 0):
        monkeypatch.setattr(decontam, "SENT_ROWS", bound)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in decontam.find_contamination(spark, frame(spark, texts), bench).collect()}
        assert got == want
    kept = decontam.drop_contaminated(spark, frame(spark, texts), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, x in want.items() if not x[1]]
    assert decontam.find_contamination(spark, odd(spark), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontam.find_contamination(spark, odd(spark).limit(0), bench).count() == 0


def test_proximity(spark):
    rng = random.Random(4)
    texts = ["x gamma y alpha beta z", "alpha q q q q q q q q q beta gamma", None, ""] + [" ".join(rng.choice("alpha beta gamma delta x y".split()) for _ in range(rng.randint(0, 25))) for _ in range(40)]
    docs = frame(spark, texts, [None, *range(1, len(texts))])
    phrases = [["alpha", "beta", "gamma"], ["delta", "delta", "x"], ["gamma"]]
    ph = spark.createDataFrame([(p,) for p in phrases], "phrase array<string>")
    terms = ph.select(F.explode("phrase").alias("term")).distinct()
    rank = decontam.ranked(ph, decontam.term_counts(docs, terms, 5)).coalesce(1).withColumn("pid", F.monotonically_increasing_id())
    index = decontam.build_index(docs, terms, 5)
    by = {r["pid"]: (r["phrase"], r["terms"][0]["term"]) for r in rank.collect()}
    got = {(r["doc"], r["pid"], r["pos"]) for r in decontam.proximity_matches(index, rank, 3, 5).collect()}
    want = set()
    for doc, t in zip([None, *range(1, len(texts))], texts):
        w = (t or "").split()
        for pid, (phrase, rarest) in by.items():
            for p, word in enumerate(w):
                if word == rarest and any(set(phrase) <= set(w[max(0, b) : b + 5]) for b in range(p - 4, p + 1)):
                    want.add((doc, pid, p))
    assert got == want and len(want) > 20


# ---- op10


def test_token_counts(spark):
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = tokens.PieceCounts(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice([" ", " ", "\n", "a", "the", "é", "▁", "\t", "x1", "  ", "<s>", "\x00", "漢"]) for _ in range(rng.randint(0, 9)))
        assert tokens.weigh(Counter(tokens.pre_tokens(t)), counts) == len(p.encode(t))
    got = sorted(tokens.count_tokens(odd(spark)).collect(), key=str)
    texts = [(r["doc_id"], r["text"] or "") for r in odd(spark).collect()]
    assert got == sorted(((i, len(t.encode()), len(p.encode(t))) for i, t in texts), key=str)
    assert tokens.count_tokens(odd(spark).limit(0)).count() == 0
    many = [prose(rng, rng.randint(0, 80)) for _ in range(60)]
    many += many[:5] + [None]
    want = sorted((i, len((t or "").encode()), len(p.encode(t or ""))) for i, t in enumerate(many))
    for head in (0, 1, 50, 100000):  # with what is rarer joined by shuffle
        assert sorted(map(tuple, tokens.count_tokens(frame(spark, many), head=head).collect())) == want
    table = tokens.piece_table(frame(spark, many)).collect()
    words = Counter(w for t in many for w in tokens.pre_tokens(t or ""))
    assert {r["t"]: (r["n"], r["pieces"]) for r in table} == {t: (n, counts[t]) for t, n in words.items()} and len(table) == len(words)


def test_drop_contaminated_keeps_clean_rows_of_a_shared_id(spark):
    item = "one two three four five six seven eight nine ten"
    docs = frame(spark, [f"a {item} b", "clean of null id", f"c {item}", "clean of id 7", "clean", None], [None, None, 7, 7, 8, None])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontam.drop_contaminated(spark, docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean", "clean of id 7", "clean of null id"]
