"""Personal data by fixed formats, and bootstrapped contextual extraction. Built-in functions only.

Base matches are the seeds. The words around them are lexical patterns; patterns and the
instances they surround form a graph. A pattern's confidence is the share of its instances
that are known, an instance's score follows from its patterns, and a few rounds spread both.
Candidates with a high score are added as spans of their own kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterloom.llm.common import checkpointed, text_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"context_{k}" for k in BASE))

#: Fixed formats, written for Java's engine so that no step repeats a group without bound
#: (its recursion would end on long texts) or starts again inside a run it has already tried:
#: * email: the local part begins where a run of its characters begins or the last match
#:   ended; the domain is the shortest run of its characters before an end or a double dot.
#: * ip: begins where a run of digits begins.
#: * card: whole chains of digits with single separators, of 16 to 19 digits; others would be dropped.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])"
    r"[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.?(?![A-Za-z0-9.-])|\.\.)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "candidate": r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{6,}+",
}
#: What a text must have for the pattern to be tried.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "candidate": r"[0-9@]"}

#: What a candidate sheds at its ends: a label such as ``tel:`` or ``ip=``, brackets, quotes and end signs.
LEAD = r"^(?:[\p{L}_.-]{1,24}+[:=]++)?+[\"'(\[<{]*+"
TAIL = r"(?<![)\"'\]>},.;:!?])[)\"'\]>},.;:!?]++$"

ROUNDS = 3
SUPPORT = 3.0  # known instances a pattern of two words needs
WIDE_SUPPORT = 8.0  # those of one word, a label, or a shape, which say less
LEAST_CONFIDENCE = 0.5  # of a pattern that passes scores on
LEAST_SCORE = 0.7  # of an instance that is added
AROUND = 80  # characters looked at for the words before and after


def _matches(kind: str) -> Column:
    """Array of (kind, i, gap, hit, before, after): the i-th match and the text around it.

    The pieces between matches come from splitting by the same pattern; a match's place is
    the sum of the pieces and matches before it.
    """
    pattern = PATTERNS[kind]
    text = F.col("text")
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    # A struct holds both arrays, so that the pieces are made once for a text.
    both = F.array(F.struct(pieces.alias("pieces"), hits.alias("hits")))
    made = F.flatten(
        F.transform(
            both,
            lambda b: F.transform(
                b["hits"],
                lambda h, i: F.struct(
                    F.lit(kind).alias("kind"),
                    i.alias("i"),
                    F.char_length(F.get(b["pieces"], i)).alias("gap"),
                    h.alias("hit"),
                    F.right(F.get(b["pieces"], i), F.lit(AROUND)).alias("before"),
                    F.left(F.get(b["pieces"], i + 1), F.lit(AROUND)).alias("after"),
                ),
            ),
        )
    )
    return F.when(text.rlike(GUARDS[kind]), made).otherwise(F.array().cast(
        "array<struct<kind: string, i: int, gap: int, hit: string, before: string, after: string>>"
    ))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Every second digit from the end is doubled, and the digits of all add up to a multiple of ten."""
    value = lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))
    digits = F.transform(F.filter(F.split(F.reverse(_digits(hit)), ""), lambda x: x != ""), lambda x: x.cast("int"))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: Column, hit: Column) -> Column:
    """Whether a match passes what its format asks beyond the pattern."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    ip = F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == "ip", ip)
        .when(kind == "card", _luhn(hit))
        .when(kind == "phone", F.length(_digits(hit)).between(8, 15))
        .when(kind == "candidate", hit.contains("@") | (F.length(_digits(hit)) >= 6))
        .otherwise(True)
    )


def matches(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, kind, start, end, hit, before, after): base matches that hold, and candidates that
    overlap none of them. A row without any has one line with a null kind."""
    found = rows.select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "text"
    ).select("uid", "doc_id", F.explode_outer(F.concat(*[_matches(k) for k in PATTERNS])).alias("m")).select("uid", "doc_id", "m.*")
    length = F.char_length("hit")
    so_far = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = found.withColumn("end", F.sum(F.col("gap") + length).over(so_far).cast("int")).withColumn("start", F.col("end") - length)
    loose = F.col("kind") == "candidate"
    ends = {"lead": F.when(loose, F.regexp_extract("hit", LEAD, 0)), "tail": F.when(loose, F.regexp_extract("hit", TAIL, 0))}
    cut = whole.withColumns({n: F.coalesce(c, F.lit("")) for n, c in ends.items()})
    lead, tail = F.char_length("lead"), F.char_length("tail")
    core = F.greatest(F.char_length("hit") - lead - tail, F.lit(0))
    placed = cut.withColumns({
        "start": F.col("start") + lead, "end": F.col("start") + lead + core, "hit": F.substring("hit", lead + 1, core),
        "before": F.concat("before", "lead"), "after": F.concat("tail", "after"),
    })
    held = placed.withColumn("kind", F.when(_holds(F.col("kind"), F.col("hit")), F.col("kind")))
    base = F.col("kind").isin(*BASE)
    # Candidates that overlap a base match, which begins before or after: one running pass each way.
    upward = Window.partitionBy("uid").orderBy("start", base.desc()).rowsBetween(Window.unboundedPreceding, 0)
    downward = Window.partitionBy("uid").orderBy(F.col("start").desc(), base.asc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.max(F.when(base, F.col("end"))).over(upward) > F.col("start"), F.lit(False))
    around = F.coalesce(F.min(F.when(base, F.col("start"))).over(downward) < F.col("end"), F.lit(False))
    free = held.withColumn("inside", inside).withColumn("around", around)
    kept = F.when((F.col("kind") != "candidate") | ~(F.col("inside") | F.col("around")), F.col("kind"))
    return free.withColumn("kind", kept).select("uid", "doc_id", "kind", "start", "end", "hit", "before", "after")


def _cues(before: str = "before", after: str = "after", hit: str = "hit") -> Column:
    """Lexical patterns of an occurrence, each with the letter of its sort: the two words before (t),
    the word before and the one after (b); and the wide ones: the word before (w), a label before
    ``:`` or ``=`` (l), and the word before, or the beginning of a line, with the shape of the instance (s)."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    left = plain(before)
    two = F.regexp_extract(left, r"(\S+\s+\S+)\s*$", 1)
    one = F.regexp_extract(left, r"(\S+)\s*$", 1)
    nxt = F.regexp_extract(plain(after), r"^\s*(\S+)", 1)
    label = F.regexp_extract(left, r"([\p{L}_]+)\s*[:=]+\s*[\"'(\[<{]*$", 1)
    shape = F.left(F.regexp_replace(F.regexp_replace(F.lower(hit), r"\p{L}+", "a"), "[0-9]+", "0"), F.lit(40))
    begins = F.when((one == "") | F.col(before).rlike(r"\n\s*$"), F.lit("^")).otherwise(one)
    return F.filter(
        F.array(
            F.when(two != "", F.concat(F.lit("t "), two, F.lit(" _"))),
            F.when((one != "") & (nxt != ""), F.concat(F.lit("b "), one, F.lit(" _ "), nxt)),
            F.when(one != "", F.concat(F.lit("w "), one, F.lit(" _"))),
            F.when(label != "", F.concat(F.lit("l "), label, F.lit(": _"))),
            F.concat(F.lit("s "), begins, F.lit(" _ "), shape),
        ),
        lambda p: p.isNotNull(),
    )


def scores(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) of candidates, from the graph of patterns and instances.

    Edges are distinct, so copies of a text count once, and all sums fold before they move.
    A pattern with very many instances is one row of sums.
    """
    edges = checkpointed(
        found.filter("kind IS NOT NULL")
        .select(F.lower("hit").alias("instance"), F.col("kind").alias("seed"), F.explode(_cues()).alias("pattern")).distinct()
    )
    sizes = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("n"))
    seeds = edges.filter("seed <> 'candidate'").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    known = seeds
    for _ in range(rounds):
        support = (
            edges.select("instance", "pattern").distinct().join(known, "instance")
            .groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
            .filter(F.col("s") >= F.when(F.left("pattern", F.lit(1)).isin("t", "b"), SUPPORT).otherwise(WIDE_SUPPORT))
        )
        patterns = support.join(sizes, "pattern").withColumn("confidence", F.col("s") / (F.col("n") + 1)).filter(
            F.col("confidence") >= LEAST_CONFIDENCE
        )
        spread = (
            edges.filter("seed = 'candidate'").join(patterns, "pattern").groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        )
        known = checkpointed(seeds.unionByName(spread.join(seeds, "instance", "left_anti")))
    return known.join(seeds, "instance", "left_anti")


def personal_spans(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end) in code points, end exclusive, for every row.

    Spans are ordered by kind as in KINDS, then start. Base spans are always kept. Null and
    empty texts have none; repeated rows are separate rows. Whole texts are searched, each
    pattern in linear time, and texts never move: only matches and the words around them do.
    """
    found = checkpointed(matches(text_rows(docs, id_col=id_col, text_col=text_col)))
    best = (
        scores(found, rounds).filter(F.col("score") >= LEAST_SCORE)
        .groupBy("instance").agg(F.max(F.struct("score", "kind"))["kind"].alias("best"))
    )
    added = (
        found.filter("kind = 'candidate'").join(best, F.lower("hit") == F.col("instance"))
        .select("uid", "doc_id", F.concat(F.lit("context_"), "best").alias("kind"), "start", "end")
    )
    base = found.select("uid", "doc_id", F.when(F.col("kind") != "candidate", F.col("kind")).alias("kind"), "start", "end")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct(order.alias("order"), "start", "end", "kind"))
    return (
        base.unionByName(added).groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
        .select("doc_id", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    )
