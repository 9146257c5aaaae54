import math
import re

from pyspark.sql import functions as F

from seismark.llm import pii_surrogates as pii
from seismark.llm import secret_scan, shared
from tests.conftest import TINY
from tests.llm import cases

TEXTS = [
    (1, "call +1 (017) 555-7713 or 017-555-7713 now"), (2, "x thea.34@mail7.example.com THEA.34@MAIL7.EXAMPLE.COM!! 4539578763621486 and 4539 5787 6362 1486"),
    (3, "Mr. John Smith met Mrs Smith and Dr. Anna Weber at 10.20.30.40; Herr Müller, Mr Иван Петров; Mr John Smith"), (4, "DE89 3704 0044 0532 0130 00 ssn 123-45-6789"),
    (5, "clean 12 34 v1.2.3 2024-01-02 1,234.5 00:11"), (6, "bob@x.org"), (7, "ann@x.org and 10.20.30.40"),
]


def test_surrogates(spark):
    out = {r.doc_id: r for r in pii.with_surrogates(spark.createDataFrame(TEXTS, "doc_id long, text string"), "k").collect()}
    assert out[5].text == TEXTS[4][1] and out[5].n_entities == 0
    a, b = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}) now", out[1].text).group(1, 3)
    assert a and b and out[1].n_entities == 2
    low, high, card, spaced = re.fullmatch(r"x (\S+@\S+) (\S+@\S+?)!! (\d{16}) and (\d{4} \d{4} \d{4} \d{4})", out[2].text).groups()
    assert low.upper() == high and re.fullmatch(r"[a-z]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", low)
    assert spaced.replace(" ", "") == card != "4539578763621486"
    digits = [int(c) for c in card[::-1]]
    luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10
    want = [int(c) for c in "4539578763621486"[::-1]]
    assert (luhn == 0) == (sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(want)) % 10 == 0)
    m = re.fullmatch(r"Mr\. (\S+ \S+) met Mrs (\S+) and Dr\. (\S+) (\S+) at (\S+); Herr (\S+), Mr (\S+ \S+); Mr (\S+ \S+)", out[3].text)
    assert m[1] == m[8] and m[1].split()[1] == m[2] and m[1].split()[0] in pii.FIRST_NAMES["male"] and m[3] in pii.FIRST_NAMES["female"] and re.fullmatch(r"[А-Яа-яё ]+", m[7])
    assert m[5] in out[7].text and "10.20.30.40" not in out[7].text
    assert out[6].text.split("@")[1] == out[7].text.split()[0].split("@")[1] and not set(out[6].text.split()) & set(out[7].text.split())
    for r in out.values():
        assert not re.search(r"John Smith|Mrs Smith|Anna Weber|Müller|Петров|bob@|ann@|6789|4539", r.text)


def test_collisions_are_resolved(spark):
    """More names than there are surrogates of two words: every one stays distinct, and none is a name of the corpus."""
    n = 3000
    found = spark.range(n).select(F.lit("family").alias("kind"), F.concat(F.lit("a"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("value"), F.lit("").alias("detail")).unionByName(
        spark.createDataFrame([("family", "smith", ""), ("family", "brown", ""), *[("phone", f"{i:03d}", "") for i in range(400)]], "kind string, value string, detail string"))
    rows = pii.surrogate_table(found, "k").collect()
    made = [(r.kind, r.surrogate) for r in rows]
    assert len(made) == n + 402 == len(set(made)) and not {s for _, s in made} & {"smith", "brown"}
    assert not {r.surrogate for r in rows if r.kind == "phone"} & {f"{i:03d}" for i in range(400)}


def test_full_formats(spark):
    """Every number of a format is in the corpus: no surrogate of that format is free, and still all are distinct."""
    found = spark.createDataFrame([("phone", f"{i:02d}", "") for i in range(100)], "kind string, value string, detail string")
    made = [r.surrogate for r in pii.surrogate_table(found, "k").collect()]
    assert len(set(made)) == 100 and not set(made) & {f"{i:02d}" for i in range(100)}


WHO = [
    (1, "Mr John Smith came. John Smith left. Smith said 5"), (2, "I met John Smith and Anna Weber in Paris"), (3, "Smith alone, Smithson too, and John Weber"),
    (4, "9807915762804490 45.116.239.51 x 4539578763621486 233.254.104.120"), (5, "9807915762804490 3. The end of 12 items 9807915762804490 12 items"), (6, "4539578763621486 017-555-7713 4539 5787 6362 1486 12"),
    (7, "born 1980-02-03 and DOB: 3/2/1980, not 2024-01-02"), (8, "at 12 Elm Street, Hauptstraße 5b, Calle Mayor, 5"), (9, "2001:db8::1 at 00:11:22 with a::b"), (10, "call 555-7713 in 10-2000"),
]


def test_coreference(spark):
    out = {r.doc_id: r.text for r in pii.with_surrogates(spark.createDataFrame(WHO, "doc_id long, text string"), "k").collect()}
    first, last, again, alone = re.fullmatch(r"Mr (\w+) (\w+) came. (\w+ \w+) left. (\w+) said 5", out[1]).groups()
    assert again == f"{first} {last}" and alone == last and not {first, last} & {"John", "Smith"}
    other = re.fullmatch(rf"I met {first} {last} and (\w+) (\w+) in Paris", out[2]).groups()
    assert other[0] in pii.FIRST_NAMES["female"] and out[3] == f"Smith alone, Smithson too, and {first} {other[1]}"
    card, ip, card2, ip2 = out[4].replace(" x", "").split(" ")
    assert ip.count(".") == ip2.count(".") == 3 and ip != "45.116.239.51" and len(card) == len(card2) == 16
    assert out[5] == f"{card} 3. The end of 12 items {card} 12 items"
    assert re.fullmatch(rf"{card2} \d{{3}}-\d{{3}}-\d{{4}} {' '.join(re.findall('....', card2))} 12", out[6])
    y, m, d = re.match(r"born (\d{4})-(\d\d)-(\d\d)", out[7]).groups()
    assert out[7] == f"born {y}-{m}-{d} and DOB: {int(d)}/{int(m)}/{y}, not 2024-01-02" and (y, m, d) != ("1980", "02", "03")
    assert re.fullmatch(r"at \d\d (?!Elm)\w+ Street, (?!Haupt)\w+straße \d[a-z], Calle (?!Mayor)\w+, \d", out[8])
    assert re.fullmatch(r"(?!2001)\w{4}:\w{3}::\w at 00:11:22 with a::b", out[9]) and re.fullmatch(r"call (?!555-7713)\d{3}-\d{4} in 10-2000", out[10])


AROUND = [
    ("I saw Mr Smith Monday. Monday was fine and Smith left.", ["Smith"], ["I saw Mr ", " Monday. Monday was fine and ", " left."]),
    ("Dr Will said so. Will you come?", ["Dr Will"], [" said so. Will you come?"]),
    ("Mr Paris went to Paris.", ["Mr Paris"], [" went to Paris."]),
    ("Mr Baker met a baker. Baker paid.", ["Mr Baker"], [" met a baker. Baker paid."]),
    ("Mr MacDonald and Mrs O'Brien left; MacDonald first.", ["MacDonald", "O'Brien"], [" left; ", " first."]),
    ("Anna Weber May come.", ["Anna", "Weber"], [" May come."]),
]
#: The repeating part of each pattern, many thousand times over.
LONG = ["x@" + "a." * 60_000 + "com", "a-" * 30_000 + "@" + "b" * 30_000 + ".c" * 30_000, "1 " * 30_000 + "DE89 " + "Ab " * 30_000, "fe80:" * 20_000 + "Xweg" * 20_000]


def test_words_around_names_and_long_texts(spark):
    texts = [*(t for t, _, _ in AROUND), *LONG]
    out = dict(pii.with_surrogates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").select("doc_id", "text").collect())
    for i, (_, gone, stay) in enumerate(AROUND):
        assert not any(g in out[i] for g in gone) and all(s in out[i] for s in stay)
    assert len(out) == len(texts) and all(len(out[i + len(AROUND)]) >= len(t) // 2 for i, t in enumerate(LONG))


def test_distinct_and_coreferent(spark, monkeypatch):
    """The mapping of all entities of a made corpus, read off by position, is one to one; also where nothing is broadcast."""
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    people = [f"{a} {b}" for a in pii.FIRST_NAMES["male"][:12] for b in ("Smith", "Stone", "Wood", "Miller", "Klein")]
    rows = [(i, f"From {people[i % 60]} to {people[(i * 7) % 60]} at {i % 9}0.1.2.{i % 11}0, {10**15 + i % 13} end") for i in range(300)]
    out = dict(map(tuple, pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").select("doc_id", "text").collect()))
    maps = {}
    for i, text in rows:
        for k, (old, new) in enumerate(zip(*(re.fullmatch(r"From (\S+) (\S+) to (\S+) (\S+) at (\S+), (\d+) end", t).groups() for t in (text, out[i])))):
            maps.setdefault({0: "given", 1: "family", 2: "given", 3: "family"}.get(k, k), {}).setdefault(old, set()).add(new)
    for m in maps.values():
        assert all(len(v) == 1 for v in m.values()) and len(set.union(*m.values())) == len(m) and not set.union(*m.values()) & m.keys()


def test_corpus(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = pii.with_surrogates(docs, "k").join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        found = re.findall(r"[\w.]+@\w+\.example\.com|\d{16}|\+1 \(\d{3}\) 555-\d{4}", r.old)
        assert bool(r.n_entities) == (r.text != r.old) and not any(x in r.text for x in found)


def test_private_cases(spark):
    out = pii.with_surrogates(cases.docs(spark), "k")
    assert out.columns == [*cases.docs(spark).columns, "n_entities", "entity_kinds"]
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted((str(i), t or "") for i, t in cases.ROWS)
    assert pii.with_surrogates(cases.empty(spark), "k").count() == 0


def in_texts(findings):
    """A document for each finding."""
    assigned = F.concat("keyword", F.lit(' = "'), "candidate", F.lit('"'))
    return findings.select(F.monotonically_increasing_id().alias("doc_id"), F.concat_ws(" ", F.lit("word"), "before", F.when(F.col("keyword") != "", assigned).otherwise(F.col("candidate")), "after", F.lit("end")).alias("text"), F.col("path").alias("source"), "label", F.sha2("candidate", 256).alias("sha"))


def test_held_out_findings(spark):
    """On findings that the forest hasn't seen: nearly all secrets stay, and nearly all that only looks like one goes."""
    docs = shared.written(in_texts(secret_scan.made_findings(spark, 1500, seed=99)))
    found = secret_scan.scan(docs.select("doc_id", "text", "source"), limit=6000).join(docs.select("doc_id", "label", "sha"), "doc_id").where("secret_sha256 = sha").toPandas()
    regex, kept = found.label.mean(), found[found.kept].label.mean()
    recall = found[found.kept].label.sum() / found.label.sum()
    assert len(found) > 1400 and regex < 0.5 and kept > 0.95 and recall > 0.95


def test_features(spark):
    """Candidates, coverage, steps and odds by plain loops."""
    docs = [(1, 'the Token = "parseUserV2parse" end', "p"), (2, "abc commit 04dbebab91ab85687d33 of x", "q"), (3, "parse parse PARSE user user users xq_9", None), (4, None, "p"), (5, "x" * 20_000 + " 1", "p"), (5, "x" * 20_000 + " 1", "p")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    found = secret_scan.candidates(df, path_col="source")
    rows = sorted(map(tuple, found.drop("ordinal").collect()))
    assert rows == [(1, "parseUserV2parse", "token", "token", "end", "p"), (2, "04dbebab91ab85687d33", "", "commit", "of", "q")]
    labelled = [("k1", "token", "the", "end", "p", 1), ("k2", "token", "a", "end", "p", 1), ("k3", "", "a", "of", "q", 0), ("k4", "token", "a", "b", "q", 0)]
    known = spark.createDataFrame(labelled, "candidate string, keyword string, before string, after string, path string, label int")
    out, names = secret_scan.with_features(secret_scan.with_odds(secret_scan.with_coverage(found.withColumn("label", F.lit(None).cast("int")), df), known))
    for r in out.collect():
        c, kinds = r.candidate, "".join("a" if x.islower() else "A" if x.isupper() else "0" if x.isdigit() else "-" for x in r.candidate)
        assert r.length == len(c) and abs(r.distinct - len(set(c)) / len(c)) < 1e-9 and r.assigned == float(r.keyword != "")
        assert abs(r.coverage - sum(len(w) for w in {"parse"} if w in c.lower()) / len(c)) < 1e-9
        for i, a in enumerate("aA0-"):
            for j, b in enumerate("aA0-"):
                assert abs(r[f"step_{i}{j}"] - sum(x == a and y == b for x, y in zip(kinds, kinds[1:])) / (len(c) - 1)) < 1e-9
        for n, at in (("keyword", 1), ("before", 2), ("after", 3), ("path", 4)):
            ups, downs = (sum(x[5] == y and x[at] == r[n] for x in labelled) for y in (1, 0))
            assert abs(r[f"odds_{n}"] - math.log((ups + 1) / (downs + 1))) < 1e-9
    # A labelled row's own label is not in its odds.
    own = {r.candidate: r.odds_keyword for r in secret_scan.with_odds(known, known, folds=1 << 20).collect()}
    assert abs(own["k1"] - math.log(2 / 2)) < 1e-9 and abs(own["k4"] - math.log(3 / 1)) < 1e-9 and own["k3"] == 0


def test_secrets(spark):
    key, number = "04dbebab91ab85687d33eeaaf9ac699e1188f9", "98079157627644"
    rows = [(i, f'the token = "{key}{i:02d}" thing', "a/b.env") for i in range(40)] + [(100 + i, f"order number {number}{i:02d} of the day", "a/readme") for i in range(40)]
    rows += [(200, 'checksum: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b more', "a/readme"), (201, None, None), (202, "", ""), (203, 'password: "hunter22" x', None), (None, f'token = "{key}99"', "a"), (204, "no secrets", "x"), (204, "no secrets", "x")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, score string")
    got = {(r.doc_id, r.ordinal): r for r in secret_scan.scan(docs, limit=5000).collect()}
    assert len(got) == 83
    assert all(got[i, 0].kept for i in range(40)) and not any(got[100 + i, 0].kept for i in range(40)) and not got[200, 0].kept and got[None, 0].kept
    again = {(r.doc_id, r.ordinal): r.score for r in secret_scan.scan(docs.repartition(7), limit=5000).collect()}
    assert again.keys() == got.keys() and all(abs(got[k].score - s) < 1e-9 for k, s in again.items())


def test_secret_cases(spark):
    """No path column, repeated rows, nulls, clashing columns, an empty table."""
    labelled = secret_scan.made_findings(spark, 600)
    assert secret_scan.scan(cases.docs(spark), labelled=labelled).count() == 0 and secret_scan.scan(cases.empty(spark), labelled=labelled).count() == 0
    one = spark.createDataFrame([(7, 'token = "04dbebab91ab85687d33"', "x")] * 2 + [(None, 'token = "04dbebab91ab85687d33"', "x")], "doc_id long, text string, candidate string")
    rows = secret_scan.scan(one, labelled=labelled).collect()
    assert len(rows) == 3 and len({r.score for r in rows}) == 1


def test_given_findings(spark):
    docs = spark.createDataFrame([(1, 'sid = "Zx81kQ0pLm77Wq2A" end', "p")], "doc_id long, text string, source string")
    rows = [("Zx81kQ0pLm77Wq2B", "sid", "sid", "end", "p", 1)] * 20 + [("1234567890123456", "", "order", "of", "q", 0)] * 20 + [("x", "", "", "", "", None)]
    labelled = spark.createDataFrame(rows, "candidate string, keyword string, before string, after string, path string, label int")
    (r,) = secret_scan.scan(docs, labelled=labelled).collect()
    assert r.kept and r.keyword == "sid" and r.length == 16
