"""Secret scanning: candidates by pattern, false positives removed by a random forest; DataFrame functions and the JVM's forest only.

A candidate is a long run of token characters with a digit, or what is assigned to a name such as
token or password.  The forest sees its length, which classes of characters follow each other, how
much of it is made of words of the corpus, and the odds that labelled findings give its path, the
name it is assigned to and the words beside it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.llm.shared import small, written

_NAMES = "password|passwd|pwd|secret|token|credential|api_?key|access_?key|private_?key|auth"
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
    rf"|(?<=[\x20\t:=\x22'])(?<=(?i:{_NAMES})[\x22']?\s{{0,3}}[:=]\s{{0,3}}[\x22']?)[^\s\x22']{{6,}}+"
)
#: Labelled findings that the forest takes at most, on average.
SAMPLE_ROWS = 20_000
CLASSES = "aA0-"
ODDS = ("path", "keyword", "before", "after")


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, ordinal, candidate, keyword, before, after, path), a row for each candidate; keyword is the name that it is assigned to.

    Null and empty texts have none; a null path is the empty one.
    """
    text, path = F.col(f"`{text_col}`"), F.col(f"`{path_col}`").cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(path, F.lit("")).alias("path"), text.alias("text")).where(text.rlike("[0-9]|[:=]"))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    rows = rows.withColumn("parts", F.split("text", CANDIDATE, -1))
    sides = F.arrays_zip(F.col("found").alias("candidate"), F.transform("parts", lambda p: F.right(p, F.lit(60))).alias("left"), F.slice(F.transform("parts", lambda p: F.left(p, F.lit(40))), F.lit(2), F.size("found")).alias("right"))
    one = rows.select("id", "path", F.posexplode(F.slice(sides, F.lit(1), F.size("found"))).alias("ordinal", "x")).select("id", "path", "ordinal", "x.*")
    return one.select(
        "id", F.col("ordinal").cast("long").alias("ordinal"), "candidate",
        F.lower(F.regexp_extract("left", r"([A-Za-z_][A-Za-z0-9_.\-]*)[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?$", 1)).alias("keyword"),
        F.lower(F.regexp_extract("left", r"([\p{L}\p{N}_]+)[^\p{L}\p{N}_]*$", 1)).alias("before"),
        F.lower(F.regexp_extract("right", r"^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+)", 1)).alias("after"), "path",
    )


def _text(alphabet: str, digest: Column, size: int) -> Column:
    """`size` characters of the alphabet from a hex digest of twice as many digits at least."""
    at = lambda k: F.pmod(F.conv(F.substring(digest, 2 * k + 1, F.lit(2)), 16, 10).cast("int"), F.lit(len(alphabet))) + 1
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.substring(F.lit(alphabet), at(k), F.lit(1))), "")


_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
#: Words of made findings: what stands beside them, and what made identifiers are put together from.
_PLAIN = "the a of set use with from export header config value new run for and in".split()
_IDENTIFIERS = "user order item parse build index cache report filter worker model session widget response request handler".split()


def made_findings(spark: SparkSession, rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """Labelled findings to start from where nobody has labelled any yet: (candidate, keyword, before, after, path, label).

    Each row is drawn as a secret or as something that looks like one, and its label says which, not
    what a pattern thinks of it: keys of several issuers, hex and base64 secrets and pass phrases on
    one side; digests, UUIDs, numbers, identifiers, references to variables, fillers, paths and
    fixtures on the other.  Several of both sides share length and alphabet, and differ by the name
    assigned to, the words beside and the path alone; those overlap too.  Half of all rows stand in
    places and beside words that no other row has.
    """
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat_ws(".", F.lit(f"{seed}.{salt}"), i.cast("string")), 512)
    one = lambda salt, names: F.element_at(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(len(names))).cast("int") + 1)
    text = lambda alphabet, size: _text(alphabet, digest(1), size)
    base62 = _LOWER + _UPPER + _DIGITS
    hexes = F.when(one(2, ["0", "1"]) == "0", text(_HEX, 40)).otherwise(F.when(one(3, ["0", "1"]) == "0", text(_HEX, 32)).otherwise(text(_HEX, 64)))
    hexes = F.when(one(4, ["0", "1", "2"]) == "0", F.upper(hexes)).otherwise(hexes)
    word = lambda salt: F.concat(one(salt, _IDENTIFIERS), F.initcap(one(salt + 1, _IDENTIFIERS)), F.initcap(one(salt + 2, _IDENTIFIERS)))
    names = ["token", "api_key", "secret", "auth_token", "apikey", "access_key", "client_secret"]
    kinds = [
        (1, hexes, names), (1, hexes, ["token", "secret", "auth"]), (1, F.concat(F.lit("AKIA"), text(_UPPER + _DIGITS, 16)), ["aws_access_key_id", "access_key", ""]),
        (1, F.concat(F.lit("ghp_"), text(base62, 36)), ["token", "github_token", "", "auth"]), (1, text(base62 + "+/", 40), ["aws_secret_access_key", "secret", "secret_key"]),
        (1, F.concat(F.lit("sk_live_"), text(base62, 24)), ["api_key", "", "secret"]), (1, F.concat(F.lit("eyJ"), text(base62 + "_-", 60)), ["token", "authorization", "auth", ""]),
        (1, F.concat(one(5, _IDENTIFIERS), text(_DIGITS + "!#%", 3), F.initcap(one(6, _IDENTIFIERS))), ["password", "passwd", "pwd"]),
        (0, hexes, ["commit", "sha1", "checksum", "etag", "digest", "md5", "revision", ""]), (0, hexes, ["", "hash", "commit", "id"]),
        (0, F.concat_ws("-", text(_HEX, 8), _text(_HEX, digest(7), 4), _text(_HEX, digest(8), 4), _text(_HEX, digest(9), 4), _text(_HEX, digest(10), 12)), ["id", "uuid", "request_id", "trace", ""]),
        (0, text(_DIGITS, 16), ["", "order", "account", "number"]), (0, text(_DIGITS, 19), ["", "", "timestamp", "id"]),
        (0, F.concat(word(20), F.lit("V"), text(_DIGITS, 1)), ["token", "auth", "handler", ""]), (0, F.concat(F.lit("${"), F.upper(one(5, _IDENTIFIERS)), F.lit("_PASSWORD1}")), ["password", "secret", "pwd"]),
        (0, F.concat(one(5, ["example", "sample", "your_", "changeme", "dummy", "xxxxxxxx"]), one(6, ["token", "key", "secret", "1234567", "_here1"])), ["token", "password", "api_key", "secret"]),
        (0, F.concat_ws("/", one(5, _IDENTIFIERS), one(6, _IDENTIFIERS), F.concat(one(7, _IDENTIFIERS), text(_DIGITS, 2))), ["", "path", "src", "file"]),
        (0, F.concat(F.lit("iVBORw0KGgo"), text(base62 + "+/", 50)), ["data", "src", "image", ""]), (0, F.concat(F.lit("AKIA"), text(_UPPER + _DIGITS, 9), F.lit("EXAMPLE")), ["access_key", "aws_access_key_id", ""]),
    ]
    pick = F.pmod(F.xxhash64(F.lit(seed), F.lit("kind"), i), F.lit(len(kinds)))
    choose = lambda values: F.coalesce(*[F.when(pick == k, v) for k, v in enumerate(values)])
    real, known = choose([F.lit(label) for label, _, _ in kinds]), one(11, ["0", "1"]) == "0"
    beside = lambda salt, yes, no: F.when(known, F.when(real == 1, one(salt, yes)).otherwise(one(salt, no))).otherwise(F.substring(digest(salt), 1, 9))
    return spark.range(rows).select(
        choose([c for _, c, _ in kinds]).alias("candidate"), choose([one(12, n) for _, _, n in kinds]).alias("keyword"),
        beside(13, [*_PLAIN, "login", "bearer", "curl"], [*_PLAIN, "commit", "digest", "test", "see"]).alias("before"), beside(14, [*_PLAIN, "prod"], [*_PLAIN, "merge", "bytes", "fixture"]).alias("after"),
        beside(15, [".env", "config/prod.yaml", "src/app.py", "deploy.sh"], ["tests/fixtures.py", "docs/readme.md", "package.lock", "src/app.py"]).alias("path"), real.alias("label"),
    )


def with_coverage(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found with coverage: the share of a candidate in runs of four letters or more that are words of the corpus, three times at least.

    Only words that are runs of candidates are counted, so that no count of the whole corpus is shuffled.
    """
    runs = F.array_distinct(F.transform(F.regexp_extract_all("candidate", F.lit("[A-Za-z]{4,}"), F.lit(0)), F.lower))
    own = written(found.select("candidate", F.explode(runs).alias("word")).distinct())
    if own.isEmpty():
        return found.withColumn("coverage", F.lit(0.0))
    asked = small(written(own.select("word").distinct()))
    words = texts.select(F.explode(F.split(F.lower(F.col("text")), "[^a-z0-9+/_\\-=]+")).alias("word"))
    known = words.join(asked, "word", "left_semi").groupBy("word").count().where("count >= 3").select("word")
    share = written(own.join(small(written(known)), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered")))
    return found.join(small(share), "candidate", "left").withColumn("coverage", F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.length("candidate"))).drop("covered")


def with_odds(found: DataFrame, labelled: DataFrame, folds: int = 5) -> DataFrame:
    """found with the smoothed log odds of label 1 among the labelled findings with the same path, keyword and neighbours.

    A row that has a label itself (label is not null) sees only rows of other folds, so that no label
    is part of its own features.
    """
    fold = F.when(F.col("label").isNotNull(), F.pmod(F.xxhash64("candidate", *ODDS), F.lit(folds)))
    long = labelled.withColumn("fold", fold).select("fold", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ODDS])).alias("x"))
    counts = written(long.groupBy("x.kind", "x.value", "fold").agg(F.sum("label").alias("up"), F.sum(1 - F.col("label")).alias("down")))
    whole = counts.groupBy("kind", "value").agg(F.sum("up").alias("all_up"), F.sum("down").alias("all_down"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("up", "down")))).alias("own"))
    whole = written(whole)  # at most four rows a labelled finding, each of at most `folds` entries
    found = found.withColumn("fold", fold)
    for c in ODDS:
        table = small(whole.where(F.col("kind") == c).select(F.col("value").alias(c), "all_up", "all_down", "own"))
        left = lambda n: F.coalesce(F.col(f"all_{n}"), F.lit(0)) - F.coalesce(F.element_at("own", F.coalesce("fold", F.lit(-1)))[n], F.lit(0)) + 1.0
        found = found.join(table, c, "left").withColumn(f"odds_{c}", F.log(left("up") / left("down"))).drop("all_up", "all_down", "own")
    return found.drop("fold")


def with_features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """found with a column for each feature, and their names."""
    c = F.col("candidate")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    found = found.withColumn("kinds", kinds)
    steps = F.greatest(F.length(c) - 1, F.lit(1)).cast("double")
    columns = {"length": F.length(c).cast("double"), "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c), "assigned": (F.col("keyword") != "").cast("double")}
    columns |= {f"step_{CLASSES.index(a)}{CLASSES.index(b)}": F.regexp_count("kinds", F.lit(f"{a}(?={b})")) / steps for a in CLASSES for b in CLASSES}
    return found.withColumns(columns).drop("kinds"), [*columns, "coverage", *[f"odds_{x}" for x in ODDS]]


def scan(docs: DataFrame, *, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", trees: int = 20, depth: int = 8, limit: int = SAMPLE_ROWS, threshold: float = 0.5, seed: int = 3) -> DataFrame:
    """A row for each candidate: id, ordinal in its text, length, keyword, secret_sha256, score and kept (score >= threshold).

    labelled holds findings with columns candidate, keyword, before, after, path and label (0 or 1);
    rows without a label are left out, nulls elsewhere are empty strings.  Without it, the forest
    starts from made_findings.  It is trained on about `limit` of them, by a hash.  With labels of
    one class only, every score is 1 or 0; without any, 1.  Without the column path_col, or with
    None, every path is empty.  Null and empty texts have no candidates, repeated rows repeat theirs,
    an empty table gives an empty result, and other columns are not read.
    """
    found = written(candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col if path_col in docs.columns else None))
    labelled = made_findings(docs.sparkSession, limit) if labelled is None else labelled
    labelled = labelled.where("label IS NOT NULL").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("candidate", *ODDS)], F.col("label").cast("int").alias("label"))
    labelled = written(labelled)
    share = min(1.0, limit / max(1, labelled.count()))
    if share < 1:
        labelled = written(labelled.where(F.pmod(F.xxhash64("candidate", *ODDS), F.lit(1 << 30)) < int(share * (1 << 30))))
    out = lambda df: df.select(F.col("id").alias(id_col), "ordinal", F.length("candidate").cast("long").alias("length"), "keyword", F.sha2("candidate", 256).alias("secret_sha256"), "score", (F.col("score") >= threshold).alias("kept"))
    classes = {r[0] for r in labelled.select("label").distinct().collect()}  # 0, 1 or both
    if len(classes) < 2:
        return out(found.withColumn("score", F.lit(float(min(classes, default=1)))))
    # One scan of the texts counts the words of both.
    names = ["candidate", *ODDS]
    both = found.select("id", "ordinal", *names, F.lit(None).cast("int").alias("label")).unionByName(labelled.select(F.lit(None).cast(found.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("ordinal"), *names, "label"))
    rows, features = with_features(with_odds(with_coverage(both, docs.select(F.col(f"`{text_col}`").alias("text"))), labelled))
    rows = written(VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("id", "ordinal", *names, "label", "features"))
    # Dealt out by hash and sorted, so that every run draws the same samples.
    train = rows.where("label IS NOT NULL").repartition(8, *names).sortWithinPartitions(*names, "label")
    forest = RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(train.select("features", "label"))
    return out(forest.transform(rows.where("label IS NULL")).withColumn("score", vector_to_array("probability")[1]))
