import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import WORD, repeated_words
from pyspark.sql import functions as F

from tessera.llm import langid, media, quality, toxicity, urls
from tessera.llm.common import bounded_sample
from tessera.llm.queries import op2_toxicity, op3_media, op5_urls, op9_quality, op10_langid

# -- media


def test_png_round_trip_with_all_filters():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (7, 64), (40, 3)):
        img = rng.integers(0, 256, shape, dtype=np.uint8)
        for filters in (None, rng.integers(0, 5, shape[0])):
            assert np.array_equal(media.png_decode(media.png_encode(img, filters=filters)), img)


def direct_unfilter(filters, rows):
    """One sample after the other, as the format defines the filters."""
    out = np.zeros(rows.shape, int)
    for y in range(rows.shape[0]):
        for x in range(rows.shape[1]):
            a, b = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0)
            c = out[y - 1, x - 1] if x and y else 0
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][filters[y]]
            out[y, x] = (int(rows[y, x]) + int(guess)) % 256
    return out


def test_filters_are_undone_as_defined(monkeypatch):
    rng = np.random.default_rng(2)
    images = [(rng.integers(0, 5, n, dtype=np.uint8), rng.integers(0, 256, (n, 9), dtype=np.uint8)) for n in (1, 2, 13, 40, 13, 5)]
    for stack in (1 << 21, 200):
        monkeypatch.setattr(media, "_STACK", stack)
        assert all(np.array_equal(got, direct_unfilter(*x)) for got, x in zip(media.unfilter(images), images))
    with pytest.raises(ValueError):
        media.unfilter([(np.array([5], np.uint8), images[0][1])])


def test_stored_texts_use_all_filters(spark, sf):
    stored = [r["media"] for r in media.media_columns(spark.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert len(np.unique(np.concatenate([media.png_parse(x)[0] for x in stored]))) == 5


def test_png_damage_is_found():
    data = media.png_encode(np.arange(64, dtype=np.uint8).reshape(1, 64))
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.png_decode(bytes(broken))
    for cut in (5, 20, len(data) - 1):
        with pytest.raises((ValueError, struct.error)):
            media.png_decode(data[:cut])


def test_hash_is_of_low_frequencies():
    rng = np.random.default_rng(0)
    x = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8), int)).astype(np.uint8)
    noisy = x ^ rng.integers(0, 4, x.shape, dtype=np.uint8)
    far = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert far(media.dct_hash(x), media.dct_hash(noisy)) < 4 < far(media.dct_hash(x), media.dct_hash(x[::-1]))


def test_media_query(spark, sf):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op3_media(spark, sf).collect():
        data = texts[r["doc_id"]].encode()
        payload = data + bytes(-len(data) % 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        img = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        stored = media.png_encode(img)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        # area means, by repeating each sample 32 times, and the cosine transform by its definition
        even = np.repeat(img.astype(float), 32, axis=0).reshape(32, -1, 64).mean(axis=1).reshape(32, 32, 2).mean(axis=2)
        at = np.arange(32) + 0.5
        low = np.array([[(even * np.cos(np.pi * u * at / 32)[:, None] * np.cos(np.pi * v * at / 32)).sum() for v in range(8)] for u in range(8)]).round(6)
        bits = (low > np.median(low)).ravel()
        assert r["feature"] == f"{int(''.join('01'[int(b)] for b in bits), 2):016x}"


def test_media_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, b"x"), (None, "", b"y"), (2, "é" * 3, b"z"), (2, "é" * 3, b"z")], "doc_id long, text string, media binary")
    got = media.media_features(media.media_columns(docs)).collect()
    assert [(r["n_bytes"], r["payload_bytes"]) for r in got] == [(0, 64), (0, 64), (6, 64), (6, 64)]
    assert got[0]["media_sha256"] == got[1]["media_sha256"] and media.media_columns(docs.limit(0)).count() == 0


# -- URLs


def test_rules_match_scanning_all(spark):
    rng = random.Random(0)
    hosts = ["ads.x.gov", "example.com", "a.example.com", "com", "xcom", "b.net", "example.net", "x.org", "my-casino.org", "CASINO.net", ""]
    paths = ["/free/download/x.EXE", "/crack-it/x/download/", "/Casino/a", "/responsible-gambling/casino/", "/search/results/", "/search/results/2", "/en/", "/en/7", "/en/72?x=/de/", "/de/8#a", "/de/", "/es/q", "/EN/", "", "/ads/banner", "/loads/x"]
    pages = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)]
    pages += [(900, None), (901, "no url"), (902, "://"), (903, "a://b://c/en/"), (None, "http://com/en/x"), (904, "http://é.com/en/\n1")]
    rules = urls.HOST_RULES + urls.PATTERN_RULES + (urls.pattern_rule("*ban*", "block"), urls.host_rule("net", "allow"))
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["pattern"], r["verdict"]) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), rules).collect()}
    index = urls.RuleIndex(rules, {})
    import re

    for i, u in pages:
        host, path = urls.split_url(u)
        r = next((r for r in index.rules if re.search(r.regex, host + path if r.explicit else (host + path).lower())), None)
        assert got[i, host, path] == (r.name if r and r.explicit else None, r.name if r and not r.explicit else None, r.action if r else "allow")
    assert urls.split_url("a://B.c/en/?x") == ("b.c", "/en/") and urls.split_url("a://b://c") == ("b:", "//c")


def test_only_rules_with_the_token_are_tried():
    index = urls.RuleIndex(urls.HOST_RULES, {"com": 5, "en": 9, "example": 7, "net": 1, "de": 3, "org": 1, "es": 2})
    assert [index.rules[i].name for i in index.candidates("x.net", "/de/1")] == ["example.net/de/8", "net/de/"]
    assert index.candidates("x.net", "/fr/1") != [] and index.candidates("x.gov", "/fr/1") == []


def test_rarity_decides_what_runs():
    rule = urls.pattern_rule("^free^download^", "block")
    common = {"free": 1000, "download": 3}
    ran = []

    class Spy:
        def search(self, whole):
            ran.append(whole)
            return re.search(rule.regex, whole)

    for counts, runs in ((common, ["a.b/x/download"]), ({"free": 3, "download": 1000}, ["a.b/free/x"])):
        ran.clear()
        index = urls.RuleIndex([rule], counts)
        index.regexes = [Spy()]
        assert [index.first("a.b", p) for p in ("/free/x", "/x/download", "/x")] == [None] * 3 and ran == runs
        assert index.first("a.b", "/free/download/") is rule
    assert urls.pattern_rule("|ads.*^x^", "block").tokens == ("ads", "x") and urls.pattern_rule("^a*b^.exe|", "block").tokens == ("exe",)


def test_url_query_matches_its_sql(spark, tmp_path):
    import duckdb

    from tessera.llm.queries import ORACLE_SQL

    rng = random.Random(4)
    parts = sorted({t for r in urls.PATTERN_RULES for t in r.tokens} | {"EN", "de", "x", "é", "Casino"})
    pages = [(k, "http://" + rng.choice("./-").join(rng.choices(parts, k=3)) + rng.choice("/._-").join(["", *rng.choices(parts, k=rng.randrange(5)), rng.choice(["", "a.exe", "u.scr"])])) for k in range(3000)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in op5_urls(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE_SQL['op5_urls']})").fetchall())
    assert got == want and 300 < sum(r[4] == "block" for r in got) < 2900


def test_url_query(spark, sf):
    assert op5_urls(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


# -- quality


def test_quality_features():
    rng = random.Random(0)
    for n in (0, 1, 3, 4, 30):
        text = " ".join(rng.choices(["a", "bé", "c#"], k=n)) + "\nx y\n\nx y\n \n"
        f = dict(zip(quality.FEATURES, quality.text_features(text.encode())))
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert f["n_words"] == len(words) and f["word_chars"] == sum(map(len, words)) and f["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert f["n_dup_lines"] == len(lines) - len(set(lines)) and f["n_repeat_words"] == repeated_words(text)


def test_em_recovers_planted_classes():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    votes = np.zeros((4000, 6), int)
    for j, (hit, false) in enumerate([(0.9, 0.02), (0.5, 0.01), (0.3, 0.05), (0.6, 0.02), (0.1, 0.0), (0.8, 0.1)]):
        bad_vote = rng.random(4000) < np.where(good, false, hit)
        votes[:, j] = np.where(bad_vote, -1, np.where(rng.random(4000) < 0.7, 1, 0))
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    _, share, posterior = quality.fit_accuracies(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05 and ((posterior[where.ravel()] >= 0.5) == good).mean() > 0.97


def test_quality_query(spark, sf):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op9_quality(spark, sf).collect()
    assert len(rows) == 200
    judged = [(r["kept"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and not r["base_failed"] and labels[r["doc_id"]] is not None]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.85
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in rows)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, True), (None, "", True), (2, "a " * 200_000, True), (2, "a", True)], "doc_id long, text string, kept boolean")
    assert [r["base_failed"] for r in quality.quality_filter(docs).collect()] == [True] * 4
    assert quality.quality_filter(docs.limit(0)).count() == 0


# -- language, toxicity, language models


def test_language_query(spark, sf):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_langid(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 200 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_words_first_then_shorter_grams():
    scores = np.log(np.array([[0.9, 0.1], [0.1, 0.9], [0.2, 0.8]], np.float32))
    known = langid.Identifier(["de", "en"], {"haus": 0}, {5: {}, 4: {"<hou": 1}, 3: {"use": 2}, 2: {}, 1: {}}, scores)
    assert [x[0] for x in known(["Haus", "house"])] == ["de", "en"]
    assert np.array_equal(known.unseen("house"), scores[1]) and np.array_equal(known.unseen("muse"), scores[2]) and not known.unseen("q").any()
    assert known(["", None, "12 ²!", "__"]) == [("und", 0.0)] * 4


def direct_languages(rows, texts):
    """Fitted on all ``rows`` (text, lang) in plain Python; language and score of each text."""
    split = lambda t: [w for w in re.findall(r"[^\W\d_]+", t.lower()) if any(c.isalpha() for c in w)]
    counts = defaultdict(Counter)
    for text, lang in rows:
        for w in split(text):
            for n in (0, 5, 4, 3, 2, 1):
                marked = f"<{w}>" if n > 1 else w
                for g in [w] if n == 0 else [marked[i : i + n] for i in range(len(marked) - n + 1)]:
                    counts[n, lang][g] += 1
    langs = sorted({lang for _, lang in rows})
    kinds = {n: sum(len(counts[n, x]) for x in langs) for n in range(6)}
    total = lambda n, g: sum(counts[n, x][g] for x in langs)
    log = lambda n, g: np.array([np.log((counts[n, x][g] + 0.1) / (sum(counts[n, x].values()) + 0.1 * kinds[n])) for x in langs])

    def word(w):
        if total(0, w) >= 2:
            return log(0, w)
        for n in (5, 4, 3, 2, 1):
            marked = f"<{w}>" if n > 1 else w
            found = [log(n, g) for g in (marked[i : i + n] for i in range(len(marked) - n + 1)) if total(n, g) >= 2]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        words = split(t or "")
        s = sum(map(word, words)) if words else None
        out.append(("und", 0.0) if s is None else (langs[int(np.argmax(s))], 1 / np.exp((s - s.max()) * min(1, 30 / len(words))).sum()))
    return out


def test_languages_match_direct_computation(spark, monkeypatch):
    rng = random.Random(5)
    words = {"de": "der hund und das haus für über straße".split(), "en": "the dog and house for over street".split(), "fr": "le chien et la maison pour été".split()}
    rows = [(k, " ".join(rng.choices(words[x], k=12)), x) for k, x in enumerate(["de", "en", "fr"] * 15)]
    texts = [t for _, t, _ in rows] + ["hundehaus", "dogs x1 Straßen", "", None, "été 12", "q", "maisons, dog", "dog " * 40 + "hund " * 39]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = direct_languages([r[1:] for r in rows], texts)
    for group, piece in ((200_000, 1 << 20), (3, 10)):
        monkeypatch.setattr(langid, "_GROUP", group)
        monkeypatch.setattr(langid, "_PIECE", piece)
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(new, langid.train(docs)).collect()}
        assert [got[k][0] for k in range(len(texts))] == [w[0] for w in want]
        assert np.allclose([got[k][1] for k in range(len(texts))], [w[1] for w in want], atol=1e-4)


def test_fitted_rows_are_bounded(spark):
    """Equal and null ids don't widen the sample, and no group is ranked as a whole."""
    ids = F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id")
    rows = spark.range(20_000).select(ids, F.concat(F.lit("word "), F.col("id") % 5000).alias("text"), F.when(F.col("id") < 19_000, "en").otherwise("de").alias("lang"))
    counted = lambda df: {r["lang"]: r["count"] for r in df.groupBy("lang").count().collect()}
    assert counted(bounded_sample(rows, "lang", ["doc_id", "text"], 100, 5)) == {"en": 100, "de": 100}
    assert counted(bounded_sample(rows, "lang", ["doc_id"], 100, 5)) == {"en": 2, "de": 2}
    assert counted(bounded_sample(rows.withColumn("size", F.lit(10)), "lang", ["doc_id", "text"], 100, 5, "size", 640)) == {"en": 64, "de": 64}
    assert counted(bounded_sample(rows.withColumn("size", F.lit(11)), "lang", ["doc_id", "text"], 100, 5, "size", 640)) == {}
    sample = toxicity.sample(spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int"), rows, "doc_id", "text", "toxic", 50)
    assert len(sample[0]) == 50 and set(sample[1]) == {1}
    with pytest.raises(ValueError):
        bounded_sample(rows, "lang", ["text"], 10, 1)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, "the cat the cat", "en", 1.0), (None, None, "en", 1.0), (2, "der hund der hund", "de", 1.0), (3, "der " * 100_000, None, 1.0), (3, "...", None, 1.0)], "doc_id long, text string, lang string, `a b.c` double")
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, langid.train(docs)).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (None, "und"), (2, "de"), (3, "de"), (3, "und")], key=str)
    assert langid.identify(docs, langid.train(docs.limit(0))).where("lang_pred = 'und'").count() == 5
    one = langid.train(docs.where("lang = 'en'"))
    assert one[0] == ["en"] and {r["score"] for r in langid.identify(docs, one).where("lang_pred = 'en'").collect()} == {1.0}


def test_subwords_and_unseen_misspellings():
    rng = random.Random(0)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    texts, labels = [], []
    for k in range(300):
        text = rng.choices(words, k=30)
        if k % 3 == 0:
            text[rng.randrange(30)] = rng.choice(["zzidiotzz", "idiot", "idiots", "xidiot"])
        texts.append(" ".join(text))
        labels.append(int(k % 3 == 0))
    model = toxicity.fit(texts, np.array(labels), np.ones(300))
    seen, unseen = model.words(["idiot", "idiotic"])
    assert unseen > 0.5 * seen > 0 and unseen > model.words(words).max()
    plain, toxic = toxicity.Scorer(model).texts([" ".join(words), " ".join([*words, *["idiotic"] * 10])])
    assert toxic > plain
    buckets, owner = toxicity.subwords(["abc", "é"])
    assert owner.tolist() == sorted(owner.tolist()) and len(buckets) == 1 + 3 + 2 + 1 + 1 + 1


def test_toxicity_query_and_edge_cases(spark, sf):
    rows = op2_toxicity(spark, sf).collect()
    assert len(rows) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    docs = spark.createDataFrame([(1, None, 5), (None, "", 5), (2, "a " * 200_000, 5), (2, "a", 5)], "doc_id long, text string, score int")
    none = toxicity.train(spark.createDataFrame([], "doc_id long, toxic int"), docs)
    assert toxicity.score(docs, none).count() == 4 and toxicity.score(docs.limit(0), none).count() == 0
