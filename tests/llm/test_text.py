"""Pseudonyms, toxicity, language and url rules."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.llm import langid, pii, queries, toxicity, url_filter

DOC = "doc_id bigint, text string, hits string, keys string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "h", "k") for i, t in texts], DOC)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


PII = [
    "mail bob.42@mail8.example.com, card 4041894974608795 and 4041-8949-7460-8795 x", "+1 (988) 555-2485 from 144.35.254.1", "born 1984-02-29, 29.02.1984, 1984/02/29",
    "ssn 123-45-6789", "iban DE89370400440532013000 or GB82 WEST 1234 5698 7654 32.", "+44 20 7946 0958 and (415) 555-2671",
]
PLAIN = ["plain", "", None, "4041894974608796", "1.2.3.400", "1983-02-29", "666-45-6789", "version 2.0. 12 a@b", "DE00370400440532013000"]


def test_pseudonyms(spark):
    rows = list(enumerate([*PII, *PLAIN, PII[0] + " " + "filler " * 20000]))
    out = {r.doc_id: r for r in pii.pseudonymise(docs(spark, rows), "key").collect()}
    for i, t in rows[len(PII) : -1]:
        assert out[i].text == t and out[i].found == {}
    for i, t in rows[: len(PII)]:
        new = out[i].text
        assert len(re.findall(r"\w", new)) >= 5 and new != t
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[0-9]", "9", s))
        if "." not in t.split(" from ")[-1] or "mail" in t:
            assert shape(new) == shape(t)
    cards = re.findall(r"[0-9-]{16,}", out[0].text)
    assert all(luhn(c.replace("-", "")) for c in cards) and cards[0] == cards[1].replace("-", "") and cards[0][0] == "4"
    assert out[0].text.endswith(" x") and "@mail8.example.com" in out[0].text and out[0].found == {"email": 1, "card": 2}
    dates = re.findall(r"[0-9./-]{10}", out[2].text)
    assert dates[0] == dates[2].replace("/", "-") == "-".join(reversed(dates[1].split(".")))
    ibans = re.findall(r"[A-Z]{2}[0-9]{2}[A-Z0-9 ]*[0-9]", out[4].text)
    assert len(ibans) == 2 and all(mod97(x) for x in ibans)
    assert out[len(rows) - 1].text.split(" filler")[0] == out[0].text
    other = pii.pseudonymise(docs(spark, rows[:1]), "other").first()
    assert other.text != out[0].text
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0


@pytest.mark.parametrize("kind", ["date", "ssn", "ipv4"])
def test_pseudonyms_are_permutations(spark, kind):
    n = 400
    make = {
        "date": "date_format(date_add(DATE'1990-01-01', int(id)), 'yyyy-MM-dd')", "ssn": "concat(lpad(string(1 + id % 600), 3, '0'), '-11-', lpad(string(id + 1), 4, '0'))",
        "ipv4": "concat('10.0.', string(int(id / 200)), '.', string(id % 200))",
    }[kind]
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.expr(make).alias("text"))
    out = pii.pseudonymise(rows, "k").collect()
    assert len({r.text for r in out}) == n and all(r.found == {kind: 1} for r in out)


def test_clause_grammar():
    g = toxicity.Grammar()
    score = lambda t: g.features(t)[1]
    assert score("the weather is nice") == 0 == score(None) == score("") and score("anidiotic") == 0
    assert score("you are an idiot") > score("an idiot walked by the lake today") > score("you are not an idiot") > 0
    assert score('she said "you are an idiot"') < score("you are an idiot") > score("you are an idiot, he wrote")
    assert score("i will kill you") > 0 and score("i will kill time") == 0 == score("you may kill time")
    assert score("i will not kill you") < score("i will kill you")
    assert score("you very idiot") > score("you idiot")
    assert score("du bist ein idiot nicht") < score("du bist ein idiot") > score("idiot")
    assert g.features("you idiot. " * 50)[0] > g.features("you idiot.")[0]
    assert g.features("word " * 100_000 + "you idiot")[1] == score("you idiot")
    plain = toxicity.ToxicityModel(g, toxicity.DEFAULT_WEIGHTS)
    assert plain.score("idiot") < 0.5 < plain.score("you are an idiot")


def test_grammar_equals_each_machine_on_its_own():
    """The composed machines against marks that are looked up word by word."""
    rng = random.Random(1)
    g = toxicity.Grammar()
    t = toxicity
    for _ in range(400):
        kinds = [rng.choice([0, 0, 0, t.INSULT, t.THREAT, t.TARGET, t.NEGATION, t.REPORT, t.STRONG]) for _ in range(rng.randrange(1, 25))]
        total = 0.0
        for i, k in enumerate(kinds):
            before, behind = kinds[max(0, i - t.REACH) : i], kinds[i + 1 : i + 1 + t.REACH]
            said = t.REPORT in kinds[:i] + kinds[i + 1 :]
            w = {t.INSULT: 1.5 if t.TARGET in before + behind else 0.4, t.THREAT: 2.0 if t.TARGET in behind else 0.0}.get(k, 0.0)
            w *= 1.25 if k == t.INSULT and kinds[i - 1 : i] == [t.STRONG] else 1.0
            total += w * (0.25 if t.NEGATION in before + behind else 1.0) * (0.35 if said else 1.0)
        words = ["", "idiot", "kill", "you", "not", "said", "very"]
        assert g.clause([words[k] for k in kinds]) == pytest.approx(total)
        # a composition is its machines one after the other
        one = kinds
        for machine in t.FROM_LEFT:
            one = machine.run(one)
        assert g.left.run(kinds) == one


def test_time_is_linear_in_a_clause():
    g, took = toxicity.Grammar(), []
    for n in (4_000, 32_000):
        began = time.process_time()
        g.features("idiot you " * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]


def test_toxicity_learns_and_holds_out(spark, data):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    pos, neg = [r.score for r in out if r.toxic == 1], [r.score for r in out if r.toxic == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.9 and sum(s >= 0.5 for s in neg) <= 0.02 * len(neg)
    held = {r.doc_id for r in queries.op8_toxicity(spark, "/root/testdata/sf0.1").where("held_out").collect()}
    assert held == {r.doc_id for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_logistic_settles_on_separable_labels(noise):
    """Features that all but tell the labels apart, many of them zero: the weights stay small and the labels are met."""
    rng = np.random.default_rng(3)
    y = (rng.random(16_000) < 0.1).astype(float)
    x = rng.gamma(2.0, 3.0, (16_000, 4)) * ((rng.random(16_000) < np.where(y == 1, 1 - noise, noise))[:, None])
    w = toxicity._logistic(x, y)
    score = 1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -50, 50)))
    assert np.abs(w).max() < 100 and w[0] < 0 and min(w[1:]) >= 0
    assert ((score >= 0.5) == (y == 1)).mean() > 0.96


def test_toxicity_keeps_clean_documents(spark):
    """Thousands of made documents, a tenth of them toxic; clean ones that were held out stay below the threshold."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "ba be bi bo bu da de di do du".split() for b in "ma me mi mo mu ra re ri ro ru".split()]
    rows = []
    for i in range(4000):
        bad = i % 10 == 0
        text = rng.choices(words, k=rng.randrange(20, 300))
        for _ in range(2 + len(text) // 40 if bad else rng.random() < 0.02):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "you idiot", "stupid"]))
        rows.append((i, " ".join(text) + ".", int(bad)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(table.select("doc_id", "text"), table.where("doc_id % 2 = 0 OR doc_id % 20 = 1").select("doc_id", "toxic"))
    tried = table.withColumn("hit", (model.column(F.col("text")) >= 0.5).cast("int"))
    share = {r["toxic"]: r["share"] for r in tried.groupBy("toxic").agg(F.avg("hit").alias("share")).collect()}
    assert share[0] <= 0.02 and share[1] >= 0.9


def test_toxicity_edges(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "you are an idiot and a moron"), (3, "you are an idiot and a moron"), (None, "nice")])
    model = toxicity.fit(rows, spark.createDataFrame([], "doc_id bigint, toxic int"))
    out = toxicity.score_toxicity(rows, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[1] == by[2] == by[None] < 0.5 < by[3]
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0
    odd = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.fit(rows, odd).weights == toxicity.DEFAULT_WEIGHTS


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op9_language(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) / len(out) > 0.93 and all(0 <= r.score <= 1 for r in out)


def language_model(spark):
    train = docs(spark, [(i, "the cat and the dog are in the house " * 3) for i in range(5)] + [(i, "der hund und die katze sind im haus " * 3) for i in range(5, 10)])
    train = train.withColumn("lang", F.when(F.col("doc_id") < 5, "en").otherwise("de"))
    return train, langid.fit(train)


def test_language_edges(spark):
    train, model = language_model(spark)
    rows = docs(spark, [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat"), (5, "der hund und die katze"), (None, "the house " * 20000), (4, "the dog and the cat"), (6, "½ ² Ⅷ _ ٣")])
    out = sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(rows, model).collect())
    assert out == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de"), (6, "und")]
    assert {r.lang_pred for r in langid.identify(rows, model, min_margin=9.0).collect()} == {"und"}
    assert {r.lang_pred for r in langid.identify(rows, langid.LanguageModel({})).collect()} == {"und"}
    assert langid.fit(train.where("lang IS NULL")).dictionaries == {}
    assert langid.identify(rows.limit(0), model).count() == 0
    # a long text fills a dictionary from all of its parts; equal texts count once
    long = " ".join(f"word{i}" for i in range(60_000))
    made = langid.fit(train.limit(1).withColumn("text", F.lit(long)).unionByName(train)).dictionaries["en"]
    assert len(made) <= 1 << 16 and made.count(b"word") > 1000 and b"word5" in made and max(map(int, re.findall(rb"word([0-9]+)", made))) > 50_000


def test_language_is_the_smallest_of_plain_compressions(spark):
    """Sizes done again by hand: each block with each dictionary, summed."""
    import zstandard

    _, model = language_model(spark)
    rng = random.Random(4)
    words = "the cat dog house and are in der hund die katze sind im haus und".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 900))) for _ in range(30)]
    out = {r.doc_id: r for r in langid.identify(docs(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        sizes = {}
        for lang, data in model.dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=max(map(len, model.dictionaries.values())), source_size=langid.BLOCK, write_checksum=0, write_content_size=0, write_dict_id=0)
            packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            sizes[lang] = sum(len(packer.compress(t.encode()[k : k + langid.BLOCK])) for k in range(0, len(t.encode()), langid.BLOCK))
        first, second = sorted(sizes, key=lambda x: (sizes[x], x))
        assert out[i].lang_pred == first and out[i].margin == pytest.approx((sizes[second] - sizes[first]) / sizes[first])


def plain_judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(r.key), r.key, r.verdict) for r in rules if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "no scheme", "http://", "https://Example.COM/en/x?y=/z#w", "http://www.example.com/en/", "http://www.example.com/EN/", "http://a.b.net/es/1", "http://net/fr/", "http://xnet/fr/",
    "ftp://com", "http://com/", "http://com?x=/", "http://user@example.com:80/en/", "http://a://b.net/es/", "http://x.com/" + "p" * 50000, "http://" + "a." * 60 + "com/", "http://é.example.com/en/", "http://a.com/\nen",
]


@pytest.mark.parametrize("rules", [queries.URL_RULES, (), (url_filter.Rule("block", "com"), url_filter.Rule("allow", "example.com", "/en"))])
def test_url_rules(spark, rules):
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, URLS[4]])], "page_id bigint, url string, host string, keys string")
    out = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(rows, rules).collect()}
    assert out == {i: plain_judge(u, rules) for i, u in enumerate([*URLS, URLS[4]])}
    assert url_filter.judge_urls(rows.limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("int(substring(key, 2)) % 40 = 0")
    cascade = url_filter.build_cascade(listed.unionByName(listed.limit(3)), universe, first_rate=0.05)
    assert len(cascade.levels) > 1
    found = universe.where(cascade.contains(F.col("key")))
    assert found.count() == 500 and found.exceptAll(listed).count() == 0
    assert url_filter.build_cascade(listed.limit(0), universe).levels and universe.where(url_filter.build_cascade(listed.limit(0), universe).contains(F.col("key"))).count() == 0
