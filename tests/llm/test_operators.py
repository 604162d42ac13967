"""Every operator against a plain brute-force version, on real rows and on odd ones."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tickloom.llm import decontaminate, encode, exact_dedup, html_extract, packing, pii, shard, simhash, token_counts, token_files, toxicity
from tickloom.llm.common import fresh_path, table, tokenizer_path

SF = "/root/testdata/sf0.001"
EXTRA = "doc_id long, text string, hash string, bucket int, fp string, cards int, kept string, n long, place int, spans string"
LONG = "word " * 3000 + "x" * 70_000 + " 12 34 " * 500
ODD = [
    (1, "alpha beta  gamma\n"), (2, "alpha beta gamma "), (3, "alpha beta gamma "), (3, "alpha beta gamma "), (4, None), (5, ""), (6, "   \t"), (7, LONG), (8, LONG), (9, "Ünïcödé ß Σίσυφος 日本 🙂 <|endoftext|> x  y"),
    (None, "alpha beta gamma "), (None, None), (10, "it's  a\ttest's  ' s"), (11, " lead and trail "), (12, "\x1c odd   space   here"), (13, "é é é"), (14, "solo"), (15, "\0 zero \0"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "h", 1, "f", 2, "k", 3, 4, "s") for i, t in ODD], EXTRA).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", ["real", "odd"])
def test_exact_dedup(name, request):
    docs = request.getfixturevalue(name)
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for i, t in pairs(docs)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = []
    for i, t in rows:
        known = [x for x in groups[t] if x is not None]
        keep = min(known) if known else None
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_dedup(docs, capacity=8, start=0)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert key(map(tuple, got.collect())) == key(want)


def test_exact_dedup_without_broadcast(real, monkeypatch):
    want = key(map(tuple, exact_dedup.exact_dedup(real).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 0)
    assert key(map(tuple, exact_dedup.exact_dedup(real, capacity=16, start=0).collect())) == want


def test_directory_splits_overfull_buckets(spark, real):
    hashes = exact_dedup.marks(real).select("hash").distinct()
    own = sorted(r["hash"] % 2**64 for r in hashes.collect())
    found = exact_dedup.Directory(hashes, 10, 0)
    rows = found.place(hashes).collect()
    sizes = Counter((r["depth"], r["bucket"]) for r in rows)
    assert max(sizes.values()) <= 10 and max(r["depth"] for r in rows) > 2
    for r in rows:  # a bucket is as shallow as it can be
        h, d = r["hash"] % 2**64, r["depth"]
        assert r["bucket"] == (h >> 1) >> (63 - d) << (63 - d)
        assert sum(x >> (64 - d) == h >> (64 - d) for x in own) <= 10 and (not d or sum(x >> (65 - d) == h >> (65 - d) for x in own) > 10)


@pytest.mark.parametrize("name", ["real", "odd"])
def test_token_counts(name, request):
    import sentencepiece

    docs = request.getfixturevalue(name)
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = [(i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in pairs(docs)]
    assert key(map(tuple, token_counts.token_counts(docs).collect())) == key(want)


@pytest.mark.parametrize("name", ["real", "odd"])
def test_sharding(name, request):
    docs = request.getfixturevalue(name)
    got = shard.shard_digest(docs).collect()
    want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in pairs(docs)]
    assert key((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == key(want)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 16
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_in_many_buckets(spark, real, monkeypatch):
    def written():
        return shard.write_shards(real, fresh_path(spark, "test-shards"), n_shards=7, bucket_bytes=20_000).collect()

    got = written()
    assert key((r["doc_id"], r["text"]) for r in got) == key(pairs(real))
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.25
    monkeypatch.setattr(shard, "BROADCAST_BUCKETS", 0)
    assert key(map(tuple, written())) == key(map(tuple, got))


def test_sharding_splits_a_bucket_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "the same words again")] * 500 + [(i, f"text {i}") for i in range(40)], "doc_id long, text string").repartition(3)
    got = shard.shard_digest(docs, 4, bucket_bytes=200).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(4) for i in range(135)]


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", ["real", "odd"])
def test_simhash(name, request):
    docs = request.getfixturevalue(name)
    rows = [(i, brute_fingerprint(t, 4)) for i, t in pairs(docs)]
    roots = brute_components({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, f in rows:
        if i is not None:
            first[roots[f]] = min(i, first.get(roots[f], i))
    want = [(i, format(f, "016x"), first.get(roots[f])) for i, f in rows]
    assert key(map(tuple, simhash.simhash_groups(docs).collect())) == key(want)


def test_links_with_split_keys_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(0, 5), replace=False)) for b in base for _ in range(150)})
    keyed = spark.createDataFrame([(0, 0, f, f) for f in fps], "tbl int, key long, node long, fp long")
    got = {(r["node"], r["root"]) for r in simhash.components(simhash.links(keyed, 4, 1, chunk=64)).collect()}
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for n, r in roots.items():
        least[r] = min(n, least.get(r, n))
    sizes = Counter(roots.values())
    assert got == {(n, least[r]) for n, r in roots.items() if sizes[r] > 1}


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 1), (1, 4), (1, 9), (4, 40)])
def test_bit_sliced_comparison(words, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (5, words), dtype=np.uint64)
    fps = base[rng.integers(0, 5, 200)].copy()
    for row in fps:
        for bit in rng.choice(64 * words, rng.integers(0, radius + 2), replace=False):
            row[bit // 64] ^= np.uint64(1 << int(bit % 64))
    keys = np.sort(rng.integers(0, 4, 200))
    u, v = simhash.compare_runs(keys, fps, np.arange(200), radius, small=40)
    near = lambda a, b: keys[a] == keys[b] and sum(int(x ^ y).bit_count() for x, y in zip(fps[a].tolist(), fps[b].tolist(), strict=True)) <= radius
    roots, got = brute_components(range(200), near), brute_components(range(200), lambda a, b, e=set(zip(u.tolist(), v.tolist(), strict=True)): (a, b) in e or (b, a) in e)
    assert {frozenset(n for n in roots if roots[n] == r) for r in roots.values()} == {frozenset(n for n in got if got[n] == r) for r in got.values()}


def test_block_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    masks = simhash.block_masks(4)
    assert len(masks) == 15
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)


def jaccard(a, b, k=5):
    def of(t):
        w = t.lower().split()
        return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = of(a), of(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_groups_find_near_copies_and_leave_the_rest(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    texts = [" ".join(rng.choice(vocabulary, 300)) for _ in range(120)]
    near = []
    for t in texts[:60]:
        w = t.split()
        for at in rng.choice(300, 4, replace=False):
            w[at] = "changed"
        near.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + near)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    assert min(jaccard(a, b) for a, b in zip(texts, near, strict=False)) > 0.8
    assert sum(got[120 + i] == i for i in range(60)) >= 59
    assert all(got[i] == i for i in range(120))


def test_near_groups_on_real_rows(real):
    docs = pairs(real)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(real).collect()}
    for i, a in docs:
        for j, b in docs:
            if i < j:
                s = jaccard(a, b)
                assert s < 0.86 or got[i] == got[j]
                assert s > 0.1 or got[i] != got[j]


def texts_at_the_edge():
    """Pairs of similarity exactly 0.8, a little more and a little less: words appended in a block or scattered, long and short."""
    rng = np.random.default_rng(11)
    word = lambda n: ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(n)]
    out = []
    for n, more in [(8, 1), (7, 1), (9, 1), (10, 1), (12, 2), (204, 50), (204, 49), (204, 51), (84, 20), (84, 21), (44, 10), (44, 11)] * 6:
        base = word(n)
        out += [" ".join(base), " ".join(base + word(more))]
    for changed in (3, 4, 5, 6) * 6:
        base = word(204)
        other = list(base)
        for at in range(10, 10 + 20 * changed, 20):
            other[at] = "changed"
        out += [" ".join(base), " ".join(other)]
    return out


def test_near_groups_at_the_similarity_equal_brute_force(spark):
    texts = texts_at_the_edge()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs).collect()}
    want = [jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, len(texts), 2)]
    assert sum(want) > 40 and sum(not w for w in want) > 30 and sum(jaccard(texts[i], texts[i + 1]) == 0.8 for i in range(0, len(texts), 2)) >= 24
    assert [got[i] == got[i + 1] for i in range(0, len(texts), 2)] == want


def test_near_groups_on_real_rows_equal_brute_force(real):
    sets = {i: {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for i, t in pairs(real)}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(real).collect()}
    roots = brute_components(sorted(sets), near)
    assert len({(got[i], roots[i]) for i in got}) == len(set(got.values())) == len(set(roots[i] for i in got))


def test_similar_links_in_chunks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in sorted(rng.choice(60, 57, replace=False))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = docs.selectExpr("doc_id AS node", "0L AS root", "xxhash64(text) AS text_key").dropDuplicates(["text_key"])
    got = {(r["node"], r["root"]) for r in simhash.components(simhash.similar_links(docs, members, 5, simhash.Fraction("0.8"), chunk=25)).collect()}
    kept = sorted(r["node"] for r in members.collect())
    roots = brute_components(kept, lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    least = {r: min(i for i in kept if roots[i] == r) for r in set(roots.values())}
    assert got == {(i, least[roots[i]]) for i in kept if sum(roots[j] == roots[i] for j in kept) > 1}


ITEMS = [
    (1, "Tom has 12 apples and gives 5 apples to Mary, how many apples does Tom have left after lunch?"),
    (2, "The quick brown fox jumps over the lazy dog near the quiet river bank every single morning"),
    (3, None),
    (4, ""),
    (5, "short one"),
    (6, "A train travels 120 km in 3 hours, what is its average speed in the second half of the trip?"),
    (7, "The quick brown fox jumps over the lazy dog near the quiet river bank every single morning"),
]


def test_decontamination(spark):
    filler = "nothing to see here at all just words that fill the page and go on "
    docs = [
        (1, filler + "Peter has 99 apples and gives 7 apples to Laura, how many apples does Peter have left after lunch? " + filler, 1, True),
        (2, filler + "Peter has 99 apples and gives 7 apples to Laura, how many apples does Frank have left after lunch? ", None, False),
        (3, filler * 3, None, False),
        (4, "THE!! QUICK!! BROWN!! FOX!! JUMPS!! OVER!! THE!! LAZY!! DOG!! NEAR!! THE!! QUIET!! RIVER!! BANK!! EVERY!! SINGLE!! MORNING!!", 2, True),
        (5, None, None, False),
        (6, "", None, False),
        (7, "Short one.", 5, True),
        (8, filler + "short one " + filler, None, False),
        (9, "a train travels 80 miles in 2 days, what is its average speed in the second half of the trip?", 6, True),
        (10, "the quick brown fox jumps over", None, False),
        (11, LONG, None, False),
        (1, filler + "Peter has 99 apples and gives 7 apples to Laura, how many apples does Peter have left after lunch? " + filler, 1, True),
        (None, "The quick brown fox jumps over the lazy dog near the quiet river bank every single morning", 2, True),
    ]
    frame = spark.createDataFrame([(i, t, "x") for i, t, _, _ in docs], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, hash int")
    got = {r["doc_id"]: r for r in decontaminate.leaked_documents(frame, items).collect()}
    assert {i: r["item_id"] for i, r in got.items()} == {i: item for i, _, item, bad in docs if bad}
    assert got[1]["reparameterised"] and got[9]["reparameterised"] and not got[4]["reparameterised"]
    kept = decontaminate.decontaminate(frame, items)
    assert kept.columns == frame.columns
    assert key(r["doc_id"] for r in kept.collect()) == key(i for i, _, _, bad in docs if not bad)
    assert decontaminate.leaked_documents(frame, items.limit(0)).count() == 0


def test_decontamination_of_number_heavy_and_short_items(spark):
    filler = "nothing to see here at all just words that fill the page and go on "
    items = [("a", "Compute 12 + 34 - 5 * 6 / 2 + 9 and give 3 digits"), ("b", "What is 3 + 4 * 5 - 2?"), ("c", "Name the largest moon of Saturn"), ("d", "Yes or no"), ("e", "1 2 3 4 5 6 7 8 9 10 11 12 13 14")]
    docs = [
        (1, filler + "so. " + items[0][1] + " " + filler, "a"),
        (2, filler + "so. Compute 77 + 21 - 8 * 1 / 4 + 6 and give 5 digits " + filler, "a"),  # other numbers throughout
        (3, filler + "what is 8 + 1 * 9 - 7? " + filler, "b"),
        (4, filler + "what is 3 + 4 and 5 - 2 " + filler, None),
        (5, filler + "please name the largest moon of saturn now", "c"),
        (6, filler + "the largest moon of saturn", None),
        (7, filler + "yes or no " + filler, None),
        (8, "Yes, or no!", "d"),
        (9, filler + " ".join(map(str, range(1, 15))), "e"),
        (10, " ".join(map(str, range(20, 2000))), None),  # numbers alone are no template
        (11, filler + "what is 8 + 8 * 9 - 7? " + filler, "b"),
    ]
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {r["doc_id"]: r["item_id"] for r in decontaminate.leaked_documents(frame, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert got == {i: item for i, _, item in docs if item}


def test_decontamination_against_brute_force(spark, real):
    items = table(spark, SF, "benchmark")

    def words(t):
        return re.findall(r"[^\W_]+", t.lower().replace("ß", "ss"))

    bench = {r["item_id"]: " ".join(words(r["text"])) for r in items.collect()}
    want = {i for i, t in pairs(real) if any(b in " ".join(words(t)) for b in bench.values())}
    got = {r["doc_id"] for r in decontaminate.leaked_documents(real, items).collect()}
    assert want and want <= got
    assert len(got - want) <= 0.01 * real.count()


def test_leaks_are_the_same_for_any_partitioning(spark, real):
    items = table(spark, SF, "benchmark")
    a = decontaminate.leaked_documents(real.repartition(1), items).collect()
    assert key(a) == key(decontaminate.leaked_documents(real.repartition(7), items).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies to improve your experience.</div><header class="site-header"><h2>Daily News</h2></header>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><article><h1>A &amp; B&nbsp;title</h1><p>First   paragraph of the
story, with some words.<p><b>Second one<br>goes on.</b></p><ul><li>Point one in a list.</li></ul><div class="ad">Buy now and save.</div><p>Last words of the story, at length, before the end.</p></article>
<aside class="sidebar"><ul><li><a href="#">Related stories</a></li></ul></aside><section id="comments"><p>Great article, thanks!</p><p>Reply</p></section><form><p>Your email</p></form><footer>&copy; 2020 Example</footer>"""


def test_html_extraction(spark):
    chain = html_extract.trained()
    assert html_extract.main_text(chain, PAGE) == "A & B title\n\nFirst paragraph of the story, with some words.\n\nSecond one goes on.\n\nPoint one in a list.\n\nLast words of the story, at length, before the end."
    odd = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<html><body><article><p>broken &am"), (5, "u", "a < b and <notatag"), (6, "u", "<!-- never closed"), (7, "u", "<article><p>" + "word " * 50_000 + "</p></article>"), (None, "u", PAGE), (1, "u", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in odd], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    got = {r["page_id"]: r for r in rows}
    assert len(rows) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert got[2]["text"] == "" and got[3]["text"] == "" and got[6]["text"] == ""
    assert got[4]["text"] == "broken &am" and got[7]["n_chars"] == 249_999
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_extraction_on_held_out_pages():
    chain = html_extract.trained()
    right = total = 0
    for found, labels in html_extract.labelled_pages(200, seed=99):
        decoded = chain.decode([chain.emission(b) for b in found])
        right += sum(a == b for a, b in zip(decoded, labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_html_extraction_of_real_pages(spark):
    from html import unescape

    pages = table(spark, SF, "pages").collect()
    chain = html_extract.trained()
    for r in pages:
        inner = r["html"].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", " ", p))).strip() for p in re.split("</?(?:p|h1)>", inner)]
        assert html_extract.main_text(chain, r["html"]) == "\n\n".join(p for p in parts if p)


def test_html_extraction_of_formulas_and_open_tags():
    chain = html_extract.trained()
    text = "<p>The energy of a body at rest follows from its mass, as everyone has read in school, and it is large.</p>"
    page = f"<body><article><h1>On energy</h1>{text}<p>We write <math><mi>E</mi>=<mi>mc2</mi></math> for it.</p><svg/>{text}<p><iframe src='x'>After the frame that is never closed, the text goes on as before.</p></article></body>"
    found = html_extract.main_text(chain, page)
    assert "We write E=mc2 for it." in found and found.count("The energy of a body") == 2 and "goes on as before." in found


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_words_give_the_library_ids(tokenizer, real):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(tokenizer))
    texts = [t for _, t in pairs(real)] + [t or "" for _, t in ODD] + ["a'sb 's x", "ΑΣ ΑΣ' Σ", "İstanbul", "é ́x", "x ́y", "tab\tand  two", "<|startoftext|> a<|endoftext|>b"]
    own = encode.Encoder(tokenizer)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want and own.encode(texts) == want


@pytest.mark.parametrize("tokenizer", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library_on_random_texts(tokenizer, monkeypatch):
    rng = random.Random(11)
    parts = ["a", "B", "'s", "'", "\n", "\n\n", " ", "  ", "\t", ".", ",", "9", "12", "\u00e9", "e\u0301", "\u03a3", "\u0130", "<|endoftext|>", "<|", "|", "\x01", "\x02", "\x1c", "\u3000", " word", "Don't", "%%%", "-", "\u65e5", "\u00df", "\x00", "\r\n", "\u2026", " | ", "\ufb01"]
    own = encode.Encoder(tokenizer)
    monkeypatch.setattr(encode, "MOST", 300)  # generations change often
    monkeypatch.setattr(encode, "SLICE_BYTES", 4000)
    for _ in range(8):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)]
        assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in own.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["real", "odd"])
def test_token_files(name, request, spark):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [(i, np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")) for i, t in pairs(docs)]
    root = fresh_path(spark, "test-files")
    files = token_files.write_token_files(docs, root)
    got = sorted(token_files.read_token_files(files, root).collect(), key=lambda r: r["start"])
    assert key((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == key((i, len(t), zlib.crc32(t.tobytes())) for i, t in rows)
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()


def test_token_file_frames(spark, real):
    root = fresh_path(spark, "test-files")
    files = token_files.write_token_files(real, root)
    frames = token_files.list_frames(files, root).collect()
    first = files.first()
    fs, _ = token_files.open_fs(root)
    with fs.open_input_file(first["path"]) as f:
        data = f.read()
    import zstandard

    own = [r for r in frames if r["path"] == first["path"]]
    plain = zstandard.ZstdDecompressor().decompress(data[own[0]["offset"] : own[0]["offset"] + own[0]["size"]])
    ids, tokens = token_files.unpack_frame(plain, own[0]["wide"])
    assert token_files.pack_frame(ids, tokens, own[0]["wide"]) == plain
    damaged = bytearray(data)
    damaged[own[0]["offset"] + own[0]["size"] // 2] ^= 255
    import io

    with pytest.raises(Exception):  # noqa: B017
        token_files.read_frame(io.BytesIO(bytes(damaged)), own[0]["offset"], own[0]["size"], own[0]["check"])


@pytest.mark.parametrize("name", ["real", "odd"])
def test_packing(name, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, t in pairs(docs):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, at // 2048, at, len(p := ids[at : at + 2048]), zlib.crc32(p.tobytes())) for at in range(0, len(ids), 2048)]
    got = packing.pack(docs).collect()
    assert key(tuple(r)[:5] for r in got) == key(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    if name == "real":
        assert len(bins) <= 1.06 * (sum(w[3] for w in want) / 2048) + docs.rdd.getNumPartitions()


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(2)
    fast, open_bins, used = packing.BestFit(100, 5), {}, 0
    for length in rng.integers(1, 101, 3000).tolist():
        fits = [free for free in open_bins.values() if free >= length]
        got = fast.place(length)
        if fits:
            assert open_bins[got[0]] == min(fits)
        else:
            if len(open_bins) == 5:
                least = min(open_bins.values())
                gone = [s for s, free in open_bins.items() if free == least and s not in {x for v in fast.by_free for x in v}]
                assert len(gone) == 1
                del open_bins[gone[0]]
            assert got == (used, 0)
            open_bins[used] = 100
            used += 1
        assert got[1] == 100 - open_bins[got[0]]
        open_bins[got[0]] -= length
        if not open_bins[got[0]]:
            del open_bins[got[0]]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return [":".join(map(str, s)) for s in out]


PII = [
    (1, "mail bob.x@mail.example.com, or a@b.c_d@e.f and @x.y a@b a@.c 🙂z@q.w..r"),
    (2, "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 0255.001.0.10, 1..2.3.4 999999999999999999999.1.1.1"),
    (3, "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004 4111  1111 1111 1111 12345678901234567890 1 4111 1111 1111 1111"),
    (4, "+1 (017) 555-7713 +49 30 1234567 +1 2 +123456789012345678 (017) 555-7713 +5) 123 45 67."),
    (5, None), (6, ""), (7, "9" * 40_000 + " " + "1 " * 9_000 + "a" * 30_000 + "@" + "b." * 5_000),
    (8, 'token = "04dbebab91ab85687d33eeaaf9ac69" password: hunter2hunter2 call (017) 555-7713 id 123456789012 bob [at] mail [dot] com'),
    (1, "mail bob.x@mail.example.com"), (None, "x@y.zz"),
]


@pytest.mark.parametrize("name", ["real", "pii"])
def test_personal_data(name, request, spark):
    docs = request.getfixturevalue("real") if name == "real" else spark.createDataFrame([(i, t, 1, "s") for i, t in PII], "doc_id long, text string, cards int, spans string")
    want = []
    for i, t in pairs(docs):
        b = brute_base(t)
        want.append((i, *[sum(s.startswith(k) for s in b) for k in ("email:", "ip:", "card:", "phone:")], hashlib.sha256(",".join(b).encode()).hexdigest()))
    got = pii.personal_data_digest(docs).collect()
    assert key(tuple(r)[:6] for r in got) == key(want)
    base = {i: brute_base(t) for i, t in pairs(docs) if i != 1}
    for r in got:
        if r["doc_id"] in base:
            assert set(base[r["doc_id"]]) <= set(filter(None, r["spans"].split(",")))


def test_personal_data_candidates_and_redaction(spark):
    docs = spark.createDataFrame(PII, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.candidates(docs).collect()}
    assert {s["kind"] for s in rows[8]["spans"]} == {"secret", "phone", "id", "email"}
    text = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame([(3, "pay 4111 1111 1111 1111 to a@b.cc now"), (4, None)], "doc_id long, text string")).collect()}
    assert text == {3: "pay <card> to <email> now", 4: ""}


def test_personal_data_in_a_text_of_many_matches(spark):
    many = " ".join(f"u{i}@host{i % 7}.example.com" for i in range(20_000)) + " (017) 555-7713" * 300
    docs = spark.createDataFrame([(1, many)], "doc_id long, text string")
    start = time.monotonic()
    (row,) = pii.personal_data_digest(docs).collect()
    assert time.monotonic() - start < 60
    assert row["n_email"] == 20_000 and row["base_sha256"] == hashlib.sha256(",".join(brute_base(many)).encode()).hexdigest()


def test_added_spans_of_labelled_texts(spark):
    """Planted secrets, phone numbers without a country and spelled-out addresses, and look-alikes that are none."""
    rng = random.Random(3)
    words = "the river runs past old mill house and green field while people walk home".split()
    filler = lambda: " ".join(rng.choices(words, k=8))
    rows, planted = [], {}
    for i in range(600):
        key = "".join(rng.choices("0123456789abcdef", k=rng.choice([18, 32, 40])))
        found = [f'token = "{key}"', f"password={key}", "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16)), f"call ({rng.randint(201, 989)}) 555-{rng.randint(1000, 9999)}"][i % 4]
        clean = [f"order 1{rng.randint(10**8, 10**9 - 1)}", f"version {rng.randint(1, 99)}.{rng.randint(0, 9)}", f"in {rng.randint(1000, 2100)}", "AKIAbc and token ring"][i % 4]
        before, middle = filler() + " ", f" {filler()} {clean} "
        span = found[5:] if found.startswith("call ") else found
        at = len(before) + len(found) - len(span)
        rows.append((i, before + found + middle))
        planted[i] = (at, at + len(span))
    out = {r["doc_id"]: [tuple(map(int, s.split(":")[1:])) for s in filter(None, r["spans"].split(","))] for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum(planted[i] in found for i, found in out.items())
    total = sum(map(len, out.values()))
    assert hit / len(planted) > 0.9, hit
    assert hit / total > 0.9, total
    for found in out.values():
        found.sort()
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_estimates_of_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.array([[(1 if t else -1) if rng.random() < q else (-1 if t else 1) if rng.random() < 0.7 else 0 for q in (0.9, 0.8, 0.85, 0.6, 0.7, 0.8)] for t in truth])
    counted = Counter(("id", tuple(v)) for v in votes.tolist())
    patterns = sorted((k, v, n) for (k, v), n in counted.items())
    prior, rate, p = pii.estimate(patterns)
    assert abs(prior["id"] - 0.4) < 0.05
    assert rate[1][0][2] > rate[1][3][2]
    by = {v: x for (_, v, _), x in zip(patterns, p, strict=True)}
    assert np.mean([(by[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.93


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" idiot ": 4.0, " trash ": 4.0, " lowei": 4.0}, [" trash can "])
    walk = lexicon.automaton()
    hits = lambda t: lexicon.features(walk, toxicity.fold(t))[0] > 0
    assert all(map(hits, ["an idiot.", "IDIOT!!!", "1d10t", "!diot", "ıdіоt", "i​diot", "ｉｄｉｏｔ", "the trash", "Loweischaft###", "idiot$$$"]))
    assert not any(map(hits, ["idiotic", "the trash can is full", "fine", "", "slowei", "2024 10 11"]))


def test_toxicity_on_rows_it_never_learned_from(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    scored = toxicity.score_documents(docs, lexicon).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 == r["toxic"] for r in scored)
    assert hit / max(1, sum(r["predicted"] for r in scored)) > 0.9
    assert all(0 <= r["score"] <= 1 for r in scored)
    assert hit / sum(r["toxic"] for r in scored) > 0.9


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0)], "doc_id long, toxic int, quality int")
    lexicon = toxicity.learn(odd, labels)
    rows = toxicity.score_documents(odd, lexicon).collect()
    assert len(rows) == len(ODD) and not any(r["predicted"] for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows if r["doc_id"]} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in ODD if i}
    bad = spark.createDataFrame([(1, "you idiot, you absolute moron"), (2, "a fine day")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score_documents(bad, lexicon).orderBy("doc_id").collect()] == [1, 0]
    assert [r["doc_id"] for r in toxicity.drop_toxic(bad, labels).collect()] == [2]


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([(1, "some item of a benchmark with enough words in it")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert token_counts.token_counts(empty).count() == 0
    assert shard.shard_digest(empty).count() == 0
    assert decontaminate.leaked_documents(empty, items).count() == 0
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert token_files.token_file_digest(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert pii.personal_data_digest(empty).count() == 0
    assert toxicity.score_documents(empty, toxicity.learn(empty, labels)).count() == 0


def test_near_groups_of_odd_rows(odd):
    rows = simhash.near_groups(odd).collect()
    assert len(rows) == len(ODD)
    ids = {r["doc_id"]: r["component_id"] for r in rows}
    assert ids[2] == ids[3] == ids[1] == 1 and ids[7] == ids[8] == 7 and ids[4] == ids[5] == ids[6] == 4


def test_redaction_of_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "mail a@b.com now"), (1, "nothing here to see at all x"), (None, "c@d.org"), (None, None), (1, "mail a@b.com now")]
    want = key([(1, "mail <email> now"), (1, "nothing here to see at all x"), (None, "<email>"), (None, ""), (1, "mail <email> now")])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(map(tuple, pii.redact(docs).collect())) == want
    docs.coalesce(1).write.parquet(f"{tmp_path}/docs")
    assert key(map(tuple, pii.redact(spark.read.parquet(f"{tmp_path}/docs")).collect())) == want
