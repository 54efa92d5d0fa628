"""Secrets in texts, with DataFrame functions alone.

Three patterns give the base: values assigned to names such as password, access key ids and long hexadecimal runs. Two
character Markov models find more: one of random strings, one of ordinary identifiers. A run of letters, digits and the
signs of base64 is a secret if the log-likelihood ratio of the two is high enough per transition, and in all.

The models are trained on labelled strings: what the base patterns match is random, and so are DRAWS strings drawn by a
hash; runs of LEAST_TRAINED characters and more of all texts, with what the base matches taken out, are ordinary. Each
distinct string counts once. Found and drawn strings have the same total weight, so the model doesn't turn with the
amount of secrets in the corpus.

Places of matches come from what lies between them: a text is split at its matches, and the ends are the running sums of
the lengths, by a prefix scan in log n steps of array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.shared import stored

#: The kinds in order, their patterns, and the least characters of what must be long enough. The look ahead
#: of the first one only spares tries of all names where none can begin.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?=[PpSsTtAa][AaEeOoPp][SsCcKkIi])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
VALUE = 6
#: What the models judge: whole runs that no other letter or digit touches.
RUN = r"(?<![\p{L}\p{N}+/_-])[A-Za-z0-9+/_-]{%d,}+(?![\p{L}\p{N}])"
LEAST_JUDGED, LEAST_TRAINED, DRAWS = 16, 10, 4_000
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
K = len(ALPHABET)
#: The ratio in nats: for each transition, and in all; the different characters that a random string has at least.
PER_STEP, IN_ALL, DIFFERENT = 1.2, 18.0, 8
#: Where a model has seen little after a character, it goes by how frequent the next one is anyway.
SMOOTHING, BACK_OFF = 0.5, 20.0


def scan(values: Column, combine, neutral: Column) -> Column:
    """Running ``combine`` over an array, by doubling: after step j each item covers 2^(j+1) items up to it."""

    def step(x: Column, j: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), j)
        moved = F.concat(F.array_repeat(neutral, far), F.slice(x, 1, F.size(x) - far))
        return F.when(F.size(x) <= far, x).otherwise(F.zip_with(x, moved, combine))

    return F.aggregate(F.sequence(F.lit(0), F.lit(30)), values, step)


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _ends(text: Column, pattern: str, found: Column) -> Column:
    """Where the matches end, in code points."""
    moves = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, hit: F.length(gap) + F.length(hit))
    return F.when(F.size(found) > 0, scan(moves, lambda a, b: a + b, F.lit(0))).otherwise(F.array().cast("array<int>"))


def _spans(ends: Column, found: Column, kind: int) -> Column:
    return F.zip_with(ends, found, lambda e, hit: F.struct((e - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), e.alias("end")))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, base): the base spans of every whole text as array<struct<start, kind, end>>, by start, then kind.

    Places are code points from 0, ends exclusive. Null texts count as empty.
    """
    text = F.col("text")
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.select("id", "text", _found(text, ASSIGN).alias("a"), _found(text, ACCESS).alias("k"), _found(text, HEX).alias("h"))
    out = out.select("id", "text", "a", "k", "h", _ends(text, ASSIGN, F.col("a")).alias("ae"), _ends(text, ACCESS, F.col("k")).alias("ke"), _ends(text, HEX, F.col("h")).alias("he"),
                     F.when(F.size("a") > 0, _found(text, ASSIGN, 2)).otherwise(F.array().cast("array<string>")).alias("v"))
    assigned = F.filter(F.zip_with(_spans(F.col("ae"), F.col("a"), 0), F.col("v"), lambda s, v: F.struct(s.alias("s"), (F.length(v) >= VALUE).alias("long"))), lambda x: x["long"])
    every = F.concat(F.transform(assigned, lambda x: x["s"]), _spans(F.col("ke"), F.col("k"), 1), _spans(F.col("he"), F.col("h"), 2))
    return out.select(F.col("id").alias(id_col), "text", F.array_sort(every).alias("base"))


def _codes(string: Column) -> Column:
    return F.transform(_found(string, "(?s)."), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))


def _steps(codes: Column) -> Column:
    """The number of each pair of neighbours: from * K + to; null where a character isn't in the alphabet."""
    pair = lambda a, b: F.when((a > 0) & (b > 0), (a - 1) * K + b - 1)
    return F.zip_with(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), pair)


def drawn_strings(spark: SparkSession, n: int = DRAWS) -> DataFrame:
    """(string): n random strings in the letters of base64, and n hexadecimal ones, always the same."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(n).select(F.explode(F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "[=\\s]", ""))).alias("string"))


def labelled_strings(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(string, label): the distinct training strings of all texts: 'found' by the base patterns, or 'ordinary'."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    text = F.col("text")
    out = texts.select(text, _found(text, ASSIGN).alias("a"), F.concat(_found(text, ACCESS), _found(text, HEX)).alias("k"))
    values = F.filter(F.transform(F.col("a"), lambda x: F.regexp_extract(x, ASSIGN, 2)), lambda v: F.length(v) >= VALUE)
    bare = F.when((F.size("a") > 0) | (F.size("k") > 0), F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")).otherwise(text)
    out = out.select(F.array_union(values, F.col("k")).alias("found"), F.array_distinct(_found(bare, RUN % LEAST_TRAINED)).alias("ordinary"))
    both = F.concat(F.transform("found", lambda s: F.struct(s.alias("string"), F.lit("found").alias("label"))), F.transform("ordinary", lambda s: F.struct(s.alias("string"), F.lit("ordinary").alias("label"))))
    return out.select(F.inline(both)).distinct()


def train(labelled: DataFrame) -> DataFrame:
    """One row (ratios array<double>): for each pair of characters ln(P(to | from) among random strings / among ordinary).

    ``labelled``: (string, label) with the labels found, drawn (both random) and ordinary. Nulls are left out; without any
    strings all ratios are 0. Counting is one aggregate over pairs of characters, of which there are K * K.
    """
    pairs = labelled.where("string is not null").select("label", F.explode(_steps(_codes(F.col("string")))).alias("step")).where("step is not null")
    counts = pairs.groupBy("step").agg(*[F.count_if(F.col("label") == x).cast("double").alias(x) for x in ("found", "drawn", "ordinary")])
    sums = counts.agg(F.sum("found").alias("sf"), F.sum("drawn").alias("sd"))
    weight = F.when((F.col("sf") > 0) & (F.col("sd") > 0), F.col("sd") / F.col("sf")).otherwise(F.lit(1.0))
    table = counts.crossJoin(F.broadcast(sums.select(weight.alias("w")))).select("step", (F.col("found") * F.col("w") + F.col("drawn")).alias("random"), "ordinary")
    grid = labelled.sparkSession.range(K * K).select(F.col("id").cast("int").alias("step")).join(table, "step", "left").na.fill(0.0)
    # K rows of K items: small groups, as many as the alphabet has characters
    ends = grid.groupBy((F.col("step") % K).alias("to")).agg(F.sum("random").alias("er"), F.sum("ordinary").alias("eo"))
    over = Window.partitionBy()
    alone = lambda n: (F.col(n) + SMOOTHING) / (F.sum(n).over(over) + SMOOTHING * K)
    grid = grid.join(F.broadcast(ends.select("to", alone("er").alias("ar"), alone("eo").alias("ao"))), F.col("step") % K == F.col("to"))
    rows = grid.groupBy((F.col("step") / K).cast("int").alias("from")).agg(F.sum("random").alias("nr"), F.sum("ordinary").alias("no"), F.array_sort(F.collect_list(F.struct("step", "random", "ordinary", "ar", "ao"))).alias("to"))
    share = lambda n, total, alone: (n + BACK_OFF * alone) / (total + BACK_OFF)
    logs = F.transform("to", lambda x: F.log(share(x["random"], F.col("nr"), x["ar"]) / share(x["ordinary"], F.col("no"), x["ao"])))
    return rows.select("from", logs.alias("logs")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "logs"))), lambda x: x["logs"])).alias("ratios"))


def fit(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The model of a corpus, as a stored table of one row of K * K doubles."""
    drawn = drawn_strings(docs.sparkSession).select("string", F.lit("drawn").alias("label"))
    return stored(train(labelled_strings(docs, text_col).union(drawn)))


def is_random(string: Column, ratios: Column) -> Column:
    """Whether the models take a run of characters for a random string."""
    codes = _codes(string)
    total = F.aggregate(_steps(codes), F.lit(0.0), lambda s, step: s + F.coalesce(F.get(ratios, step), F.lit(0.0)))
    several = F.size(F.array_distinct(_found(string, "(?s)."))) >= DIFFERENT
    return several & (total >= IN_ALL) & (total >= PER_STEP * (F.length(string) - 1))


def _apart(base: Column, more: Column) -> Column:
    """The spans of ``more`` that touch none of ``base``, which is in order: by scans over both together, not pair by pair."""
    both = F.array_sort(F.concat(base, more))
    upto = scan(F.transform(both, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0))), lambda a, b: F.greatest(a, b), F.lit(0))
    never = F.lit(2**31 - 1)
    after = F.reverse(scan(F.reverse(F.transform(both, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(never))), lambda a, b: F.least(a, b), never))
    seen = F.zip_with(both, F.zip_with(upto, after, lambda u, a: F.struct(u.alias("u"), a.alias("a"))), lambda s, n: F.struct(s.alias("s"), n.alias("n")))
    kept = F.filter(seen, lambda x: (x["s"]["kind"] == 3) & (x["n"]["u"] <= x["s"]["start"]) & (x["n"]["a"] >= x["s"]["end"]))
    return F.transform(kept, lambda x: x["s"])


def find_secrets(docs: DataFrame, model: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, secrets): spans of every whole text as array<struct<start, kind, end>>, in order; kinds as in KINDS.

    ``secrets`` holds the base spans and those that the models add where no base span is. ``model`` comes from ``train``
    (None: from ``fit`` on the same texts). Rows are independent: repeated rows and null ids stay; null and empty texts have
    no spans. Other columns are not carried. One pass without a shuffle, besides training; of the model, K * K numbers come
    to the driver.
    """
    fitted = (fit(docs, text_col) if model is None else model).first().ratios
    ratios = F.split(F.lit(",".join(map(repr, fitted))), ",").cast("array<double>")  # one literal after constant folding
    text, none = F.col("text"), F.array().cast("array<struct<start:int,kind:int,end:int>>")
    run = RUN % LEAST_JUDGED
    out = base_spans(docs, id_col, text_col).select(id_col, "text", "base", _found(text, run).alias("runs"))
    judged = F.transform("runs", lambda s: is_random(s, ratios))
    out = out.select(id_col, "text", "base", "runs", F.when(F.size("runs") > 0, judged).otherwise(F.array().cast("array<boolean>")).alias("judged"))
    # most texts have no such run, and no place is worked out for them
    spans = F.zip_with(_spans(_ends(text, run, F.col("runs")), F.col("runs"), 3), F.col("judged"), lambda s, j: F.struct(s.alias("s"), j.alias("j")))
    more = F.transform(F.filter(spans, lambda x: x["j"]), lambda x: x["s"])
    out = out.select(id_col, "base", F.when(F.exists("judged", lambda j: j), more).otherwise(none).alias("more"))
    added = F.when(F.size("more") > 0, F.when(F.size("base") > 0, _apart(F.col("base"), F.col("more"))).otherwise(F.col("more"))).otherwise(none)
    return out.select(id_col, "base", F.array_sort(F.concat("base", added)).alias("secrets"))


def _spelled(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) of what ``find_secrets`` gives."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(id_col, count(0), count(1), count(2), F.sha2(_spelled(F.col("base")), 256).alias("base_sha256"), _spelled(F.col("secrets")).alias("spans"))
