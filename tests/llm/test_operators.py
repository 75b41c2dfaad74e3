"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties, repeated rows,
no rows at all, and extra columns whose names clash with the operator's own."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import attention_lm as lm
from plumbline.llm import language_id, line_dedup, lm_scoring, suffix_sort, warc
from plumbline.llm.bpe_transducer import ByteBpe, Encoder, Lexicon, build_automaton, compile_lexicon, decode_documents, encode_documents, round_trip, write_lexicon
from plumbline.llm.components import components
from plumbline.llm.decontaminate import leaks, without_leaks
from plumbline.llm.hamming_search import top_k
from plumbline.llm.idset import maybe_in
from plumbline.llm.line_dedup import line_report, without_duplicate_lines
from plumbline.llm.lm_scoring import score_documents
from plumbline.llm.minhash_join import near_duplicates
from plumbline.llm.repeat_spans import without_repeats
from plumbline.llm.scratch import Scratch
from plumbline.llm.token_counts import token_counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = "rep long, component long, key string, id string, place string, rank int, size int, lang_ll string, line string"


def docs_of(spark, texts, ids=None, extra=True):
    """A documents table; with columns whose names operators use inside."""
    rows = [(i, t) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    names = [c.split(" ") for c in CLASH.split(", ")]
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in names])


def sentences(seed, n, words=30, vocabulary=400):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randint(1, words))) for _ in range(n)]


def near_copy(text, seed, edits=1):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
    return " ".join(w)


def roots(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    edges = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}
    assert components(edges.limit(0), Scratch(spark, "t")).count() == 0


def test_maybe_in_keeps_all(spark):
    kept = {r.id for r in maybe_in(spark.range(5000), "id", spark.range(0, 5000, 13)).collect()}
    assert set(range(0, 5000, 13)) <= kept and len(kept) < 1000


# 1


def test_hamming_top_k(spark):
    r = random.Random(3)
    codes = [r.getrandbits(64) for _ in range(150)]
    codes += [c ^ (1 << r.randrange(64)) for c in codes[:60]] + codes[:30] * 2 + [codes[0]] * 40  # near, ties, many copies
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    df = spark.createDataFrame([*rows, (None, 5), (999, None), rows[3]], "id long, code long")
    got = collections.defaultdict(list)
    for x in top_k(df, df.where("id % 7 = 0"), 5).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.distance, x.id))
    for q, c in enumerate(codes):
        if q % 7 == 0:
            assert got[q] == sorted((bin(c ^ d).count("1"), i) for i, d in enumerate(codes) if i != q)[:5]
    assert top_k(df.limit(0), df, 5).count() == 0
    assert top_k(df.where("id = 3").limit(1), df.where("id = 3").limit(1), 5).count() == 0


# 2


def shingled(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def test_near_duplicates(spark):
    base = sentences(1, 40, 80)
    long = " ".join(sentences(2, 400, 60))
    texts = base + [near_copy(base[i % 10], i, 1 + i % 4) for i in range(60)] + [base[3]] * 5 + [base[4].upper()] + [None, "", " \n", "one", "one", "One  two", long, near_copy(long, 1, 3)]
    got = {r.doc_id: r for r in near_duplicates(docs_of(spark, texts), 4, 80).collect()}
    sets = [shingled(t, 4) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(len(texts), links)
    assert [got[i].component_id for i in range(len(texts))] == expected
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (expected[i] == i) for i in got)
    assert near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_near_duplicates_without_ids(spark):
    got = near_duplicates(docs_of(spark, ["a b c d e f"] * 3, [None, 4, 4]), 4).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("4", 4), ("4", 4), ("None", None)]


# 3

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", "\t", "é", "'s", "'ll", "_", "1", "½", "漢", "<|endoftext|>", "!", "\r\n", "\x1c", "\x85", "\xa0", "the", "ß", "٣", "\0"]


def test_automaton_is_minimal_and_exact():
    words = sorted({"".join(p).encode() for n in range(1, 5) for p in itertools.product("ab", repeat=n)})
    a = build_automaton(words)
    assert len(a["final"]) <= 6  # one state for each length is enough
    assert build_automaton([])["key"].size == 0


def test_bpe_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    r = random.Random(5)
    texts = ["".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", "x" * 50_000, "ab" * 3000 + " the end", "The end. " * 2000]
    df = docs_of(spark, texts)
    lexicon = compile_lexicon(spark, df, TOKENIZER)
    got = {x.doc_id: x for x in round_trip(df, TOKENIZER, lexicon).collect()}
    ids = {x.doc_id: x.ids for x in encode_documents(df, TOKENIZER, lexicon).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    decoded = decode_documents(spark.createDataFrame([(1, [50256, 464]), (2, None), (3, [447])], "doc_id long, ids array<int>"), TOKENIZER).collect()
    assert [x.text for x in sorted(decoded)] == ["<|endoftext|>The", "", "�"]
    assert round_trip(df.limit(0), TOKENIZER, compile_lexicon(spark, df.limit(0), TOKENIZER)).count() == 0
    bpe = ByteBpe(TOKENIZER)
    write_lexicon(str(tmp_path / "l"), [b" the", b" then", b" hen"], bpe)
    words = [" the", " th", " then", " hens", "é"]
    assert Encoder(bpe, Lexicon(str(tmp_path / "l"))).ids_of(words) == Encoder(bpe).ids_of(words)


# 4


def test_suffix_order():
    r = np.random.default_rng(0)
    for _ in range(60):
        text = r.integers(0, r.integers(2, 6), r.integers(1, 80)).astype(np.uint8)
        raw = text.tobytes()
        for spill in (1 << 20, 2):  # in memory, and all on disk
            assert suffix_sort.suffix_order(text, 1000, spill).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def cut_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if t[k : k + length] in seen:
                gone[k : k + length] = [True] * length
            seen.add(t[k : k + length])
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def test_without_repeats(spark):
    base = sentences(4, 25, 90)
    r = random.Random(1)
    mixed = [base[i][: r.randrange(len(base[i]))] + base[(i * 7) % 25] + base[(i * 3) % 25][r.randrange(5) :] for i in range(25)]
    texts = base + mixed + [None, "", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, "é" * 120 + "\0" * 150, " ".join(base) * 2, "a" * 100]
    expected = cut_repeats([(t or "").encode() for t in texts], 100)
    got = {x.doc_id: x for x in without_repeats(docs_of(spark, texts).repartition(3), 100).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == expected
    twice = without_repeats(docs_of(spark, ["b" * 120 + "c", "b" * 120], [5, 5]), 100).collect()
    assert sorted(x.n_removed for x in twice) == [119, 120]
    assert without_repeats(docs_of(spark, texts).limit(0)).count() == 0


# 5


def brute_leaks(texts, items, percent=80):
    cut = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)])(WORD.findall((t or "").lower()))
    out = {}
    for d, t in texts.items():
        s = cut(t)
        for i, b in items.items():
            b, best = cut(b), 0.0
            for k in range(max(len(s) - len(b), 0) + 1 if b and s else 0):
                x, y = collections.Counter(s[k : k + len(b)]), collections.Counter(b)
                best = max(best, sum((x & y).values()) / sum((x | y).values()))
            if best * 100 >= percent:
                out[d, i] = best
    return out


def test_leaks(spark):
    items = dict(enumerate(sentences(7, 12, 60)))
    items |= {20: "too short", 21: None, 22: "", 23: "one two three four five", 24: "ab cd ef gh ij " * 12}
    fill = sentences(8, 40, 60)
    texts = dict(enumerate(fill))
    texts |= {100 + i: f"{fill[i]} {items[i % 12].upper()} {fill[i + 1]}" for i in range(20)}
    texts |= {200 + i: f"{fill[i]} {near_copy(items[i % 12], i)}" for i in range(20)}
    texts |= {300: None, 301: "", 302: "one two three four five", 303: items[24] + " x", 304: " ".join(fill * 20) + " " + items[3], 305: items[5]}
    df = docs_of(spark, list(texts.values()), list(texts))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.similarity for x in leaks(df, bench).collect()}
    expected = brute_leaks(texts, items)
    assert set(got) == set(expected) and all(math.isclose(got[k], expected[k]) for k in got)
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.select("doc_id").collect()} == set(texts) - {d for d, _ in expected}
    assert leaks(df, bench.limit(0)).count() == 0 and leaks(df.limit(0), bench).count() == 0


# 6


def test_language_id(spark):
    speech = {"en": "the house and the garden with an apple tree", "de": "das haus und der garten mit einem apfelbaum", "fr": "la maison et le jardin avec un pommier"}
    r = random.Random(2)
    rows = []
    for i in range(240):
        lang = list(speech)[i % 3]
        w = speech[lang].split()
        rows.append((i, " ".join(r.choice(w) for _ in range(25)), lang, f"{lang}.site.example.{lang}"))
    train, held = rows[:120], rows[120:]
    model = language_id.fit(spark.createDataFrame(train, "doc_id long, text string, lang string, host string"), per_language=30)
    assert model.languages == ("de", "en", "fr")
    df = spark.createDataFrame([*held, (900, None, None, None), (901, "12 34 !!", None, "x"), (902, "", None, "en.site.example.en"), (902, "", None, None)], "doc_id long, text string, lang string, host string").withColumn("lang_ll", F.lit("clash"))
    got = language_id.identify(df.drop("lang"), model, host="host").collect()
    of = {x.doc_id: x for x in got}
    assert len(got) == 124 and all(of[i].lang_id == lang and of[i].lang_accepted for i, _, lang, _ in held)
    assert not any(of[i].lang_accepted for i in (900, 901, 902))
    # evidence decides where the text says little
    one = spark.createDataFrame([(1, "un", "fr", "fr"), (2, "un", "de", "de")], "doc_id long, text string, declared string, suffix string")
    assert {x.doc_id: x.lang_id for x in language_id.identify(one, model, declared="declared", suffix="suffix", evidence=language_id.Evidence(temper=0.05)).collect()} == {1: "fr", 2: "de"}
    assert language_id.identify(df.limit(0), model, host="host").count() == 0


def test_posteriors_match_plain_fusion(spark):
    """Host shares, their smoothing from domain and table, declared language and suffix, all once more in plain Python."""
    r = np.random.default_rng(4)
    langs = ("de", "en", "fr")
    model = language_id.TextModel(langs, np.log(r.dirichlet(np.ones(40), size=4).T.repeat(language_id.BINS // 40 + 1, axis=0)[: language_id.BINS]).astype(np.float32))
    pick = random.Random(6)
    hosts = ["a.x.com", "b.x.com", "x.com", "c.y.org", None]
    rows = [(i, " ".join(pick.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(pick.randint(0, 6))), pick.choice(hosts), pick.choice(["EN-us", "fr", "zz", None]), pick.choice(["de", "com", None])) for i in range(80)]
    rows += [(80, None, "a.x.com", "de", "de"), (81, "12", "q.com", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string, suffix string")
    e = language_id.Evidence(temper=0.05)
    got = {x.doc_id: x for x in language_id.identify(df, model, host="host", declared="declared", suffix="suffix", evidence=e).collect()}
    scores, letters = model.score([(t or "").encode() for _, t, *_ in rows])
    n_host, n_domain, n_all = (collections.defaultdict(lambda: [0, 0, 0]) for _ in range(3))
    domain = lambda h: h and ".".join(h.split(".")[-2:])
    for row, s, n in zip(rows, scores, letters, strict=True):
        if n:
            k = int(np.argmax(s[:3]))
            n_host[row[2]][k] += 1
            n_all[""][k] += 1
    for h, n in n_host.items():
        if h is not None:
            for k in range(3):
                n_domain[domain(h)][k] += n[k]
    world = [(n_all[""][k] + 1) / (sum(n_all[""]) + 3) for k in range(3)]
    for (i, _, h, declared, suffix), s, n in zip(rows, scores, letters, strict=True):
        if h is not None and h in n_host:
            d = n_domain[domain(h)]
            prior = [(n_host[h][k] + e.smoothing * (d[k] + e.smoothing * world[k]) / (sum(d) + e.smoothing)) / (sum(n_host[h]) + e.smoothing) for k in range(3)]
        else:
            prior = world
        terms = []
        for k, lang in enumerate(langs):
            t = e.temper * s[k] + math.log(prior[k]) + math.log(1 - e.und_prior)
            for said, trust in ((declared[:2].lower() if declared else None, e.declared_trust), (language_id.SUFFIX_LANGUAGE.get(suffix), e.suffix_trust)):
                if said in langs:
                    t += math.log(trust if said == lang else (1 - trust) / 2)
            terms.append(t)
        terms.append(e.temper * s[3] + math.log(e.und_prior))
        top = max(terms)
        assert got[i].lang_id == ((*langs, "und")[terms.index(top)] if n else "und"), i
        assert math.isclose(got[i].lang_posterior, 1 / sum(math.exp(t - top) for t in terms), rel_tol=1e-4), i


def test_markup(spark):
    rows = [
        (1, "https://u:p@News.Example.FR:80/x?q=http://z.de", "<html class='a' LANG=\"fr-FR\"><script>var x='<p>no</p>'</script><p>un&nbsp;deux</p><!-- <b>no</b> --></html>"),
        (2, "no url", "<p>plain</p>"), (3, None, None), (4, "http://host/", "<html lang=de>x"),
    ]
    got = {x.page_id: x for x in language_id.markup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text.split() == ["un", "deux"] and (got[1].declared, got[1].host, got[1].suffix) == ("fr", "news.example.fr", "fr")
    assert got[2].text.split() == ["plain"] and (got[2].declared, got[2].host, got[2].suffix) == (None, None, None)
    assert (got[3].text, got[3].host) == ("", None) and (got[4].declared, got[4].host, got[4].suffix) == ("de", "host", None)


def test_likelihood_matches_plain_sums():
    table = np.random.default_rng(1).random((language_id.BINS, 3)).astype(np.float32)
    model = language_id.TextModel(("a", "b"), table)
    texts = ["Ab c", "", "é!!x", "abc " * 50]
    scores, letters = model.score([t.encode() for t in texts])
    for t, s, n in zip(texts, scores, letters, strict=True):
        folded = re.sub(b" +", b" ", b" " + bytes(language_id._FOLD[b] for b in t.encode()) + b" ")
        bins = language_id.trigram_bins(np.frombuffer(folded, dtype=np.uint8)) if len(folded) > 2 else []
        assert np.allclose(s, table[bins].sum(axis=0) if len(bins) else 0, rtol=1e-4)
        assert n == sum(c != 32 for c in folded)


# 7


@pytest.mark.parametrize("roll", [200, 1 << 20])
def test_warc_round_trip(spark, roll):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 500, "x\r\n\r\ny", "<p>a</p>", "z" * 200_000]
    rows = [(i * 3, f"http://h/{i} b" if i % 2 else None, h, "clash") for i, h in enumerate(html)] + [(9, "http://again", "<p>a</p>", "clash"), (None, None, "none", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    scratch = Scratch(spark, "w")
    where = scratch.path("a")
    manifest = warc.write_archive(pages, where, roll_bytes=roll, scratch=scratch).collect()
    assert sum(m.n_records for m in manifest) == len(rows)
    got = warc.read_archive(spark, where).collect()
    data = {i * 3: (h or "").encode() for i, h in enumerate(html)}
    for x in got:
        body = data.get(x.page_id, b"none")
        first = min((i for i, d in data.items() if d == body), default=None)
        assert x.payload_bytes == len(body) and x.payload_digest == warc.digest32(body)
        assert (x.record_type, x.refers_to) == (("response", None) if x.page_id in (first, None) else ("revisit", first))
    again = scratch.path("b")
    assert [tuple(m) for m in warc.write_archive(pages, again, roll_bytes=roll, scratch=scratch).orderBy("file").collect()] == sorted(tuple(m) for m in manifest)
    empty = scratch.path("c")
    warc.write_archive(pages.limit(0), empty, scratch=scratch)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_files_do_not_depend_on_the_session(spark):
    rows = [(i * i - 500, f"http://h/{i}", f"<p>{i % 37}</p>" * (i % 50)) for i in range(300)] + [(None, "http://none", "x"), ((1 << 63) - 1, None, "far"), (-(1 << 63), None, "far")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    scratch, seen = Scratch(spark, "w"), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("7", "31"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            where = scratch.path(n)
            seen.append(sorted(tuple(m) for m in warc.write_archive(pages.repartition(int(n) % 5 + 1), where, roll_bytes=3000, shard_bytes=9000, scratch=scratch).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len({m[0].split("-")[1] for m in seen[0]}) > 2 and sum(m[1] for m in seen[0]) == len(rows)
    assert sorted((x.page_id is None, x.page_id or 0) for x in warc.read_archive(spark, where).collect()) == sorted((r[0] is None, r[0] or 0) for r in rows)
    with pytest.raises(FileExistsError):
        warc.write_archive(pages, where, scratch=scratch)


# 8

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_unigram_base(spark):
    texts = sentences(9, 60, 40, 60) + [None, "", "Once UPON\ta time", "a " * 3000, "é ü", "w1"]
    ids = [*range(len(texts) - 1), 0]
    rows = list(zip(ids, texts, strict=True))
    got = collections.defaultdict(list)
    for x in score_documents(docs_of(spark, texts, ids), VOCABULARY, steps=3).collect():
        got[x.doc_id].append(x)
    tokens = {r: [*WORD.findall((r[1] or "").translate(LOWER)), None] for r in rows}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for r in rows if not held(r[0]) for w in tokens[r])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[r])
        same = [x for x in got[r[0]] if x.n_tokens == len(tokens[r]) and math.isclose(x.base_score, base, abs_tol=1e-6)]
        assert same and same[0].held_out == held(r[0]) and same[0].n_known == sum(counts[w] > 0 for w in tokens[r]) and same[0].train_tokens == n
        assert same[0].score < 0
    assert score_documents(docs_of(spark, texts).limit(0), VOCABULARY, steps=1).count() == 0


def test_attention_scores_each_id_once():
    """Scores by windows equal a plain loop over windows and places."""
    pieces = lm.Pieces(VOCABULARY)
    texts = [s.encode() for s in sentences(10, 4, 60)] + [b"", b"a"]
    _, words, ids, n_ids = lm.tokenized(texts, pieces)
    assert [int(n) for n in words] == [len(t.split()) for t in texts]
    classes = lm.Classes.fit(np.bincount(ids, minlength=pieces.size))
    follow = lm.follow_table(classes, np.bincount(ids, minlength=pieces.size), lm.pair_counts(classes, lm.shifted(ids, n_ids, pieces.end), ids))
    w = lm.first_weights(pieces.size)
    got = lm.score(w, classes, follow, ids, n_ids)
    start = 0
    for value, n in zip(got, n_ids.tolist(), strict=True):
        own = ids[start : start + n]
        fed = np.concatenate([[pieces.end], own[:-1]])
        total = 0.0
        for place in range(n):
            first = 0 if place < lm.WINDOW else (place // (lm.WINDOW // 2) - 1) * (lm.WINDOW // 2)
            window = np.resize(fed[first : place + 1], lm.WINDOW)[None, :]  # what comes after the place must not matter
            p, s = lm.forward(w, follow, window, 0)
            total += math.log(p[0, place - first, classes.of[own[place]]] / s[0, place - first]) + classes.log_share[own[place]]
        assert value == pytest.approx(total, rel=1e-4)
        start += n
    # the shares of all ids in their classes, and of all classes, add up to one
    p, s = lm.forward(w, follow, np.zeros((1, lm.WINDOW), dtype=np.int32), 0)
    assert np.allclose(np.bincount(classes.of, weights=np.exp(classes.log_share), minlength=lm.CLASSES)[np.unique(classes.of)], 1)
    assert np.allclose(p.sum(axis=2), s, rtol=1e-5)


def test_training_lowers_held_out_loss():
    pieces = lm.Pieces(VOCABULARY)
    _, _, ids, n_ids = lm.tokenized([s.encode() for s in sentences(11, 300, 40, 50)], pieces)
    cut = int(n_ids[:200].sum())
    classes = lm.Classes.fit(np.bincount(ids[:cut], minlength=pieces.size))
    follow = lm.follow_table(classes, np.bincount(ids[:cut], minlength=pieces.size), lm.pair_counts(classes, lm.shifted(ids[:cut], n_ids[:200], pieces.end), ids[:cut]))
    loss = lambda w: -lm.score(w, classes, follow, ids[cut:], n_ids[200:]).sum()
    assert loss(lm.train(ids[:cut], n_ids[:200], classes, follow, pieces.size, 60)) < loss(lm.first_weights(pieces.size))


# 9


def test_token_counts(spark):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(6)
    texts = ["".join(r.choice("ab  ▁\n\té,<s>漢　.0\0") for _ in range(r.randint(0, 40))) for _ in range(400)] + [None, "", " ", "<s>x</s>", "word " * 5000, "q" * 20_000]
    got = {x.doc_id: x for x in token_counts(docs_of(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts(docs_of(spark, texts).limit(0), model).count() == 0


# 10


def test_line_dedup(spark):
    base = [s for s in sentences(12, 60, 25) if len(s) > 80][:25]
    r = random.Random(7)
    pool = base + [near_copy(b, i) for i, b in enumerate(base)] + ["Of.", "Hello world foo1", "Hello world foo2", "", "  ", "x"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 6))) for _ in range(40)] + [None, "", "\n\n", base[0], base[0] + "\n" + "long " * 4000]
    got = {x.doc_id: x for x in line_report(docs_of(spark, texts)).collect()}
    gone = collections.defaultdict(list)
    for d, k in sorted(plain_removed(texts)):
        gone[d].append(k)
    assert all(got[d].removed == gone[d] for d in range(len(texts)))
    kept = {x.doc_id: x.text for x in without_duplicate_lines(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        rest = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])
        assert kept.get(d) == (rest if not gone[d] or rest.strip() else None)
    assert line_report(docs_of(spark, texts).limit(0)).count() == 0


def plain_removed(texts):
    """Lines that go by the plain definition: Jaccard 0.8 of the sets of all 5-character shingles."""
    places = [(d, k, line) for d, t in enumerate(texts) for k, line in enumerate((t or "").split("\n")) if line.strip()]
    first = {}
    for d, k, line in places:
        first.setdefault(line, (d, k))
    lines = sorted(first, key=first.get)
    sets = [{s[i : i + 5] for i in range(max(1, len(s) - 4))} for s in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = dict(zip(lines, roots(len(lines), links), strict=True))
    return {(d, k) for d, k, line in places if first[lines[root[line]]] != (d, k)}


def test_line_dedup_holds_all_character_shingles(spark):
    r = random.Random(3)
    base = ["the two parts of the line differ in de and nothing else at all as far as the eye of a reader can see now"]
    base += [" ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (3, 4, 5, 7, 9, 12, 20, 50) for _ in range(4)]
    pool = [*base, base[0].replace(" de ", " su ")]
    for k, line in enumerate(base):
        w = line.split(" ")
        for edits in (1, 1 + len(w) // 16):
            v = list(w)
            for _ in range(edits):
                v[r.randrange(len(v))] = r.choice(["su", "x", f"q{k}"])
            pool += [" ".join(v), " ".join(v[: len(v) // 2] + ["de"] + v[len(v) // 2 :])]
    pool += ["Hello world foo1", "Hello world foo2", "abc", "abd", "aaaaaa", "aaaaaaa", "abcdefgh", "abcdefghi", "long " * 300, "long " * 299 + "longer"]
    got = {(x.doc_id, k) for x in line_report(docs_of(spark, pool)).collect() for k in x.removed}
    assert got == plain_removed(pool) and len(got) > 20


def test_line_dedup_keeps_lines_alike_in_their_first_characters(spark):
    pool = ["https://www.example.org/articles/about-bees", "https://www.example.org/pictures/of-mountains", "https://www.example.org/4f1d9a07c2b8e63510"]
    pool += ["2024-01-01 10:00\tlogin\tuser alpha\tok", "2024-01-01 10:00\tshutdown\tdisk seven is full", "/usr/share/lib/aa/first.bin", "/usr/share/lib/zz/other.conf"]
    pool += ["中華人民共和國中央人民政府今天宣布新的教育政策", "中華人民共和國中央人民政府否認有關糧食價格的消息", "Unabhängigkeitserklärung", "Unabhängigkeitsbewegungen", "No. 1", "No. 2"]
    assert not plain_removed(pool)
    assert all(x.n_removed == 0 for x in line_report(docs_of(spark, pool)).collect())
    assert without_duplicate_lines(docs_of(spark, pool)).count() == len(pool)


def test_line_dedup_loses_no_link_near_the_threshold(spark):
    r = random.Random(17)
    pool = []
    for n in (20, 40, 41, 60, 100, 200, 400):
        for _ in range(12):
            line = "".join(r.choice("abcdefghijklmnopqrst ") for _ in range(n)).strip() + "z"
            at = sorted(r.sample(range(len(line)), max(1, len(line) // 46)))
            pool += [line, "".join("#" if i in at else c for i, c in enumerate(line))]
    got = {(x.doc_id, k) for x in line_report(docs_of(spark, pool)).collect() for k in x.removed}
    assert got == plain_removed(pool) and len(got) > 20


@pytest.mark.parametrize("block", [None, 5])
def test_line_dedup_compares_all_members_of_large_bands(spark, monkeypatch, block):
    """Lines made of common passages: nearly every band of two linked lines has many members, and most pivots link with neither."""
    if block:
        monkeypatch.setattr(line_dedup, "BLOCK", block)
    r = random.Random(23)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(4, 9)))
    passages, between = [" ".join(word() for _ in range(9)) for _ in range(11)], " and it was furthermore said there that "
    chosen = r.sample(list(itertools.combinations(range(11), 4)), 260)
    base = [between.join(passages[k] for k in c) for c in chosen]
    pool = base + [line.replace(line.split(" ")[k % 9], f"q{k}", 1) for k, line in enumerate(base[::4])]
    wanted = plain_removed(pool)
    got = {(x.doc_id, k) for x in line_report(docs_of(spark, pool)).collect() for k in x.removed}
    assert got == wanted and 60 < len(wanted) < len(pool) // 2


def test_line_dedup_with_repeated_and_missing_ids(spark):
    texts = ["same line here", "same line here", "same line here\n\nand a second one", "same line here", "same line here", None, None]
    df = docs_of(spark, texts, [None, 3, 3, 3, 4, 5, 5])
    kept = sorted((str(x.doc_id), str(x.text)) for x in without_duplicate_lines(df).collect())
    # which text of id 3 has the first place follows from its hash
    whole, rest = ("3", "same line here"), ("3", "\nand a second one")
    assert [x for x in kept if x[0] == "3"] in ([rest, whole], [("3", texts[2])])
    assert [x for x in kept if x[0] != "3"] == [("5", "None"), ("None", "same line here")]
    report = sorted((str(x.doc_id), x.n_lines, x.n_removed) for x in line_report(df).collect())
    assert len(report) == 7 and sum(x[2] for x in report) == 3 and report[-1] == ("None", 1, 0)
    far = docs_of(spark, ["one line of text"] * 2, [-(1 << 63), (1 << 63) - 1])
    assert [x.doc_id for x in without_duplicate_lines(far).collect()] == [-(1 << 63)]


def test_pipeline_stages_keep_their_columns(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and "ids_sha256" in last.columns


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Every stage once more in plain Python, on rows with nulls, empty texts, copies and leaks; language by the model itself."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    items = dict(enumerate(sentences(31, 3, 40)))
    fill = [s for s in sentences(32, 60, 40) if len(s) > 60][:24]
    texts = [*fill, fill[0], near_copy(fill[1], 5) + "\n" + fill[2], fill[3] + "\n" + fill[3], f"{fill[4]} {items[0]} {fill[5]}", items[1], "12 34", "", None, "\n\n" + fill[6]]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    known = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    now = {x.doc_id: x.text for x in known.collect()}
    assert set(now) == {i for i, t in enumerate(texts) if t and re.search("[a-z]", t)}
    order = sorted(now)
    gone = plain_removed([now[i] for i in order])
    now = {i: "\n".join(x for n, x in enumerate(now[i].split("\n")) if (k, n) not in gone) for k, i in enumerate(order)}
    now = {i: t for i, t in now.items() if t.strip()}
    order = sorted(now)
    sets = [shingled(now[i], 5) for i in order]
    links = [(a, b) for a, b in itertools.combinations(range(len(order)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    now = {order[k]: now[order[k]] for k, root in enumerate(roots(len(order), links)) if root == k}
    now = {i: t for i, t in now.items() if i not in {d for d, _ in brute_leaks(now, items)}}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(got) == set(now) and len(now) > 15
    for i, t in now.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_near_duplicate_stage_keeps_rows_without_an_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"word{k}" for k in range(40))
    df = docs_of(spark, [text, text, text, "another text altogether", None], [1, 2, None, None, None])
    kept = corpus_pipeline.near_duplicate_stage(spark, df, "").collect()
    assert sorted((str(x.doc_id), str(x.text)) for x in kept) == sorted([("1", text), ("None", text), ("None", "another text altogether"), ("None", "None")])


def test_lm_learns_from_every_window(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE_TEXTS", 1)
    monkeypatch.setattr(lm_scoring, "SAMPLE_CHARS", 10)
    taken = []
    inner = lm_scoring.learned
    monkeypatch.setattr(lm_scoring, "learned", lambda *a: taken.append((a[2], inner(*a))) or taken[-1][1])
    texts = [*sentences(5, 60, 200), "", None, "tail " * 4000]
    score_documents(docs_of(spark, texts), VOCABULARY, steps=2).count()
    pieces = lm.Pieces(VOCABULARY)
    train = [(t or "").encode() for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    ids, n_ids = lm.tokenized(train, pieces)[2:]
    ((start, (weights, n)),) = taken
    assert n == sum(-(-int(k) // lm.WINDOW) for k in n_ids)
    assert (np.abs(weights["emb"] - start["emb"]).max(axis=1) > 0)[np.unique(lm.shifted(ids, n_ids, pieces.end))].all()


def lm_parts(seed: int, n: int, words: int = 40):
    """(classes, follow, ids, ids of each text) of some texts."""
    pieces = lm.Pieces(VOCABULARY)
    _, _, ids, n_ids = lm.tokenized([s.encode() for s in sentences(seed, n, words)], pieces)
    counts = np.bincount(ids, minlength=pieces.size)
    classes = lm.Classes.fit(counts)
    return classes, lm.follow_table(classes, counts, lm.pair_counts(classes, lm.shifted(ids, n_ids, pieces.end), ids)), ids, n_ids


def test_lm_gradients_against_differences():
    """Of more windows than go through the layers together, some of them weighted with 0."""
    classes, follow, _, _ = lm_parts(41, 5)
    r, windows = np.random.default_rng(3), 2 * lm._AT_ONCE + 3
    ids, target = r.integers(0, 300, (windows, lm.WINDOW)), r.integers(0, lm.CLASSES, (windows, lm.WINDOW))
    weight = (r.random((windows, lm.WINDOW)) < 0.7).astype(np.float64)
    w, follow = {k: x.astype(np.float64) for k, x in lm.first_weights(len(classes.of)).items()}, follow.astype(np.float64)

    def loss():
        p, total = lm.forward(w, follow, ids, 0)
        return -(np.log(np.take_along_axis(p, target[..., None], 2)[..., 0] / total) * weight).sum() / weight.sum()

    got, g = lm.gradients(w, follow, ids, target, weight)
    assert got == pytest.approx(loss())
    for name, x in w.items():
        for _ in range(4):
            at = (int(r.choice(ids.ravel())) if name == "emb" else int(r.integers(0, x.shape[0])), int(r.integers(0, x.shape[1])))
            before, ends = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = before + step
                ends.append(loss())
            x[at] = before
            assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-9)


def test_lm_step_keeps_little_in_memory():
    """A step's windows go through the layers a few at a time: all at once they took 65 MB."""
    import tracemalloc

    classes, follow, _, _ = lm_parts(42, 5)
    r = np.random.default_rng(4)
    ids, target = r.integers(0, 300, (lm.PASS_BATCH, lm.WINDOW)), r.integers(0, lm.CLASSES, (lm.PASS_BATCH, lm.WINDOW))
    w, weight = lm.first_weights(len(classes.of)), np.ones((lm.PASS_BATCH, lm.WINDOW), dtype=np.float32)
    tracemalloc.start()
    try:
        lm.gradients(w, follow, ids, target, weight)
        assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()


LM_ALONE = """
import sys, time
sys.path[:0] = sys.argv[1:]
import numpy as np
from plumbline.llm import attention_lm as lm
r, size = np.random.default_rng(1), 2001
ids, n_ids = r.integers(0, size, 200_000).astype(np.int32), np.full(400, 500)
counts = np.bincount(ids, minlength=size)
classes = lm.Classes.fit(counts)
follow, w = lm.follow_table(classes, counts, lm.pair_counts(classes, lm.shifted(ids, n_ids, size - 1), ids)), lm.first_weights(size)
for work in (lambda: lm.train_on_all(lm.Adam(w), ids, n_ids, classes, follow, r), lambda: lm.score(w, classes, follow, ids, n_ids)):
    a, b = time.process_time(), time.thread_time()
    work()
    print((time.process_time() - a) / (time.thread_time() - b))
"""


def test_lm_works_in_its_own_thread():
    """Spark allows a worker as many threads as its executor has cores; on small matrices they mostly wait, at full load."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    run = subprocess.run([sys.executable, "-c", LM_ALONE, str(Path(lm.__file__).parents[2])], env=os.environ | {"OMP_NUM_THREADS": "4"}, capture_output=True, text=True, check=True, timeout=120)
    assert all(float(x) < 1.2 for x in run.stdout.split()), run.stdout


def test_lm_reads_texts_few_times(spark):
    """Texts are counted and cut once each; before that they are read for their number, the sample's keys and the sample."""
    texts = [*sentences(43, 20, 30), "", None]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    docs = docs_of(spark, texts)
    got = score_documents(docs.mapInArrow(count, docs.schema), VOCABULARY, steps=1).collect()
    assert len(got) == len(texts) and seen.value <= 5 * len(texts)
