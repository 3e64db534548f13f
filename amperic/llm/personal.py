"""Personal data in text: base patterns, and identifiers found by the words around them.

Everything is DataFrame functions. A text is split at the matches of each expression;
lengths of gaps and matches, summed along the text, give the positions. Values that look
like identifiers are instances, and the words around them are patterns. Instances that a
base pattern knows are seeds. Pattern and instance scores follow from each other for some
rounds: a pattern is as good as the instances it has been seen with, an instance as its
best pattern. Patterns with enough support and a high score then mark the instances
that no base pattern knows.

Scores are whole thousandths, so they do not depend on the order of sums. An instance
counts once for a pattern, however often it is written, so copies carry no weight.
Hot patterns and instances are summed before they are shuffled, and scores are joined
by key and slot, so no task reads all edges of one key.

Rules for odd input: a NULL text is empty and has no spans. Rows equal in ``doc_id`` and
text each get the spans of that text; a NULL ``doc_id`` is a value. Other columns are
ignored. An empty table gives an empty table. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amperic.llm.common import staged, whole_text

KINDS = ("email", "ip", "card", "phone", "learned")
EMAIL, IP, CARD, PHONE, OTHER = range(5)

# The base patterns, written so that every match takes linear time: a run is tried from its
# head only, and what is matched is not given back. Shorter cards could not be valid.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# What may be an identifier: the above, or a token with four digits or more.
_JOINT = r"[._/@+#:-]"
TOKEN = rf"(?<![A-Za-z0-9]|{_JOINT})(?=(?:(?:[A-Za-z]|{_JOINT})*+[0-9]){{4}})[A-Za-z0-9](?:{_JOINT}?+[A-Za-z0-9])++"
INSTANCE = "|".join((PATTERNS[EMAIL], PATTERNS[PHONE], PATTERNS[CARD], TOKEN))
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

CONTEXT = 64  # characters on either side that words are taken from
SLOTS = 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of up to 19 digits is right."""
    at = F.reverse(digits)

    def term(i: Column) -> Column:
        d = F.substring(at, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda sum_, i: sum_ + term(i)) % 10 == 0


def valid(kind: int, value: Column) -> Column:
    """What a match of a base pattern must meet besides."""
    digits = _digits(value)
    if kind == IP:
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == CARD:
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == PHONE:
        return F.length(digits).between(9, 15)
    return F.lit(True)


def is_seed(value: Column) -> Column:
    """Whether a base pattern knows the whole value."""
    whole = lambda k: value.rlike(rf"^(?:{PATTERNS[k]})$")
    return F.coalesce(whole(EMAIL), F.lit(False)) | F.greatest(*[F.when(whole(k), valid(k, value)).otherwise(F.lit(False)) for k in (IP, CARD, PHONE)])


def _words(text: Column) -> Column:
    plain = F.lower(F.regexp_replace(text, "[0-9]+", "0"))
    return F.filter(F.split(plain, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def lexical_patterns(before: Column, after: Column) -> Column:
    """The two words before, and the word on either side; none without a word before."""
    left, right = _words(before), _words(after)
    one, two = F.try_element_at(left, F.lit(-1)), F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit(""))
    next_ = F.coalesce(F.try_element_at(right, F.lit(1)), F.lit(""))
    both = F.array(F.concat_ws(" ", two, one, F.lit("*")), F.concat_ws(" ", one, F.lit("*"), next_))
    return F.when(one.isNotNull(), both).otherwise(F.array().cast("array<string>"))


def occurrences(docs: DataFrame) -> DataFrame:
    """Every match: ``doc_id``, ``row`` (a hash of the text), ``kind``, ``start``, ``end``;
    for instances also ``instance``, ``seed`` and ``patterns``."""
    text = F.col("text")
    found = []
    for kind, pattern in enumerate((*PATTERNS, INSTANCE)):
        hits = F.regexp_extract_all(text, F.lit(pattern), 0)
        gaps = F.when(F.size(hits) > 0, F.split(text, pattern, -1))
        found.append(F.struct(F.lit(kind).alias("kind"), hits.alias("hits"), gaps.alias("gaps")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("row"), F.inline(F.array(*found))).filter(F.size("hits") > 0)
    gap = lambda i: F.get(F.col("gaps"), i)
    hits = F.transform(
        "hits",
        lambda h, i: F.struct(
            h.alias("value"), F.length(gap(i)).alias("gap"), F.right(gap(i), F.lit(CONTEXT)).alias("before"), F.left(gap(i + 1), F.lit(CONTEXT)).alias("after")
        ),
    )
    rows = rows.select("doc_id", "row", "kind", F.posexplode(hits).alias("i", "hit")).select("doc_id", "row", "kind", "i", "hit.*")
    value, kind = F.col("value"), F.col("kind")
    ok = F.when(kind == OTHER, value.contains("@") | (F.length(_digits(value)) >= 4))
    for k in (IP, CARD, PHONE):
        ok = ok.when(kind == k, valid(k, value))
    other = lambda c: F.when(kind == OTHER, c)
    rows = rows.select(
        "doc_id", "row", "kind", "i", "gap", F.length("value").alias("size"), ok.otherwise(F.lit(True)).alias("ok"),
        other(F.md5(F.lower("value").cast("binary"))).alias("instance"), other(is_seed(value)).alias("seed"),
        other(lexical_patterns(F.col("before"), F.col("after"))).alias("patterns"),
    )
    along = W.partitionBy("doc_id", "row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.dropDuplicates(["doc_id", "row", "kind", "i"]).withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along))
    return rows.filter("ok").select(
        "doc_id", "row", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "instance", "seed", "patterns"
    )


def _slotted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("_slot", F.pmod(F.xxhash64(by), F.lit(SLOTS)).cast("int"))


def _in_all_slots(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))


def learned_patterns(found: DataFrame, *, rounds: int = 3, least: int = 600, support: int = 3) -> DataFrame:
    """``pattern``, ``score`` and ``support`` of the patterns that may mark identifiers.

    ``found`` has the instances of :func:`occurrences`. A pattern's score is the sum of
    its instances' scores over their number and one, in thousandths; ``support``
    instances or more must be known or found by then.
    """
    edges = found.select("instance", "seed", F.explode("patterns").alias("pattern")).distinct()
    edges = staged(_slotted(edges, "pattern").withColumnRenamed("_slot", "_by_instance"))
    scores = None
    for step in range(rounds):
        score = F.when(F.col("seed"), F.lit(1000))
        if scores is None:
            known = edges.withColumn("score", score.otherwise(F.lit(0)))
        else:
            told = _in_all_slots(scores).withColumnRenamed("_slot", "_by_instance")
            known = edges.join(told, ["instance", "_by_instance"], "left").withColumn("score", score.otherwise(F.coalesce("found", F.lit(0))))
        good = known.groupBy("pattern").agg(
            F.expr(f"sum(score) div (count(*) + 1)").alias("score"), F.count(F.when(F.col("score") > 0, 1)).alias("support")
        )
        good = staged(good.filter((F.col("score") >= least) & (F.col("support") >= support)))
        if step + 1 < rounds:
            wide = _slotted(edges.filter(~F.col("seed")), "instance").join(_in_all_slots(good), ["pattern", "_slot"])
            scores = staged(wide.groupBy("instance").agg(F.max("score").alias("found")))
    return good


def personal_spans(docs: DataFrame, *, rounds: int = 3, least: int = 600, support: int = 3) -> DataFrame:
    """``doc_id``, ``row``, ``kind``, ``start``, ``end`` of base and learned spans; learned
    ones that touch a base span are left out."""
    found = staged(occurrences(docs))
    base = found.filter(F.col("kind") < OTHER).select("doc_id", "row", "kind", "start", "end")
    others = found.filter(F.col("kind") == OTHER)
    good = learned_patterns(others, rounds=rounds, least=least, support=support)
    marked = others.filter(~F.col("seed")).select("doc_id", "row", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    marked = marked.withColumn("_slot", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(SLOTS)).cast("int"))
    marked = marked.join(_in_all_slots(good.select("pattern")), ["pattern", "_slot"], "left_semi").select(*base.columns).distinct()
    line = W.partitionBy("doc_id", "row").orderBy("start", "kind")
    is_base = F.col("kind") < OTHER
    reach = F.max(F.when(is_base, F.col("end"))).over(line.rowsBetween(W.unboundedPreceding, 0))
    next_ = F.min(F.when(is_base, F.col("start"))).over(line.rowsBetween(0, W.unboundedFollowing))
    told = base.unionByName(marked).withColumns({"_reach": reach, "_next": next_})
    alone = F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    return told.filter(is_base | alone).drop("_reach", "_next")


def find_personal(docs: DataFrame, *, rounds: int = 3, least: int = 600, support: int = 3) -> DataFrame:
    """``doc_id``, the counts of base kinds, ``base_sha256``, ``spans`` and ``n_learned``."""
    spans = personal_spans(docs, rounds=rounds, least=least, support=support)
    listed = spans.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    listed = listed.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "all")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("row"))
    rows = rows.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    rows = rows.select("doc_id", F.coalesce("all", F.array().cast(listed.schema["all"].dataType)).alias("all"))
    name = F.array(*map(F.lit, KINDS))
    line = lambda list_: F.array_join(F.transform(list_, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("all", lambda s: s["kind"] == kind)).cast("long")
    base = line(F.filter("all", lambda s: s["kind"] < OTHER))
    return rows.select(
        "doc_id", *[of(k).alias(f"n_{KINDS[k]}") for k in (EMAIL, IP, CARD, PHONE)], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        line(F.col("all")).alias("spans"), of(OTHER).alias("n_learned"),
    )
