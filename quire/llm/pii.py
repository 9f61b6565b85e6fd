"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

Base spans of four kinds come from patterns with checks (parts of an ip, Luhn's sum,
numbers of digits). They are the seeds. What stands left of a seed on its line, the last two
words or one label (ending in : = or #), is a lexical pattern of the seed's kind. What may
be found beside the base: things of a kind's rough shape (a wider regular expression), and
in a pattern's slot any single word that is no plain word (it holds a digit, a dot, an @ or
the like within).

Patterns and what follows them (values, by their first words) form a graph. The slot of
each pattern that several such things follow is read over the whole corpus, and whatever
different words stand there count, ordinary ones as well. In each round a pattern's
confidence is the share of its slot's different contents that begin with a known value;
the shapes that a pattern of enough support and confidence precedes become known, and
support further patterns in the next round, until nothing is added. Shapes that are known
and words that are no plain words, right of a trusted pattern, are added where they touch
no base span and no candidate before them; base spans always stay.

Positions: splitting a text at the matches gives the stretches between them, and running
sums of the lengths of stretches and matches give starts and ends in code points. The sums
are windows over matches, each running in one direction, so a text with very many of them
costs no more than a sort.

Documents without a digit or an @ are never matched. The regular expressions start at the
first character of a run only (or where the last match ended), as a start inside a run
cannot match if the run's own start did not; so a long run is passed once.

Defined results: a null text is empty, with no spans and the checksum of an empty string;
null ids and repeated rows are documents of their own; spans that start together go by
kind as listed, and of candidates that touch the first by start and kind stays; a very
long text is one row of its matches; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; possessive where nothing that follows could give back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Rough shapes of the same kinds, for candidates.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++| ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*+)",
    "ip": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{3,6}){2,4}+(?![0-9])",
    "phone": r"(?<![0-9(+.])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{3,5}){1,3}+(?![0-9])",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
SUPPORT, CONFIDENCE = 5, 0.8
#: Words of a slot that are looked at, and of a value that tell it apart.
AHEAD = 6
#: Words of a line that are taken at a time.
STRETCH = 64
#: One document in so many gives a first bound on a slot's contents.
LOOK = 16
#: Where words end: blanks, and after a mark that opens or labels what follows.
BREAK = r"\s+|(?<=[:=#(\[<\"'])(?=\S)"
WORD = r"[^\s:=#(\[<\"']*[:=#(\[<\"']|[^\s:=#(\[<\"']+"
#: What is cut from a word's end; what a word holds within that is no plain word.
TAIL = r"[.,;!?)\]>\"']+$"
NO_WORD = r"[0-9@_]|\w[.+/%-]\w"
#: Characters left of a match that its pattern is taken from.
REACH = 80


def luhn(digits: Column) -> Column:
    """Whether Luhn's sum of a string of digits is a multiple of ten."""
    backward = F.split(F.reverse(digits), "")
    doubled = F.transform(backward, lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def hits(text: Column, regex: str) -> Column:
    """Of each match: code points since the last one, its own, itself, and what is left of it."""
    def each(gap: Column, match: Column) -> Column:
        return F.when(match.isNotNull(), F.struct(F.length(gap).alias("gap"), F.length(match).alias("len"), match.alias("value"), F.right(gap, F.lit(REACH)).alias("left")))

    return F.filter(F.zip_with(F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0)), each), lambda x: x.isNotNull())


def words(line: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(line)), BREAK, -1), lambda w: w != "")


def context(left: Column) -> Column:
    """The lexical pattern in what is left of a match: a label, or the last two words."""
    return _pattern(words(F.element_at(F.split(left, "\n", -1), -1)))


def _pattern(said: Column) -> Column:
    last = F.element_at(said, -1)
    return F.when(F.size(said) == 0, None).when(last.rlike("[:=#]$"), last).when(F.size(said) > 1, F.array_join(F.slice(said, -2, 2), " "))


def value_key(value: Column) -> Column:
    """By which a value is known: its first words, in lower case, without marks at the end."""
    return F.regexp_replace(F.array_join(F.slice(words(value), 1, AHEAD), " "), TAIL, "")


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All documents (row, doc_id), and their matches with positions: base or candidate."""
    t = F.col("t")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    numeric, mail = t.rlike("[0-9]"), t.contains("@") | t.contains("(at)") | t.contains("[at]") | (t.contains(" at ") & t.contains(" dot "))
    columns = []
    for tier, patterns in (("base", BASE), ("wide", WIDE)):
        for kind, regex in patterns.items():
            guard = {"email": t.contains("@") if tier == "base" else mail, "phone": t.contains("+") & numeric if tier == "base" else numeric, "ip": numeric if tier == "base" else t.contains(":")}.get(kind, numeric)
            columns.append(F.struct(F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.when(guard, hits(t, regex)).alias("hits")))
    # Written once: row numbers stay what they are, whatever is computed again later.
    facts, _ = written(source.select("row", "doc_id", F.xxhash64("t").alias("version"), F.filter(F.array(*columns), lambda x: F.size(x["hits"]) > 0).alias("found")), "pii")
    order = Window.partitionBy("row", "tier", "kind").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        facts.select("row", F.explode("found").alias("x"))
        .select("row", "x.tier", "x.kind", F.posexplode("x.hits").alias("pos", "h"))
        .withColumn("end", F.sum(F.col("h.gap") + F.col("h.len")).over(upto))
        .select("row", "tier", "kind", (F.col("end") - F.col("h.len")).alias("start"), "end", F.col("h.value").alias("value"), context(F.col("h.left")).alias("pattern"))
    )
    good = placed.where(F.when(F.col("tier") == "base", valid(F.col("kind"), F.col("value"))).otherwise(True))
    found, _ = written(apart(good), "pii-spans")
    return facts.select("row", "doc_id", "version"), found


def apart(found: DataFrame) -> DataFrame:
    """Base spans, and the candidates that touch no base span and no candidate before them."""
    base = F.col("tier") == "base"
    order = F.when(base, 0).otherwise(1)
    # None of the base that starts before it ends after its start, and the next one starts
    # no sooner than its end. Both frames run from the first row on, so each is one pass.
    first = Window.unboundedPreceding
    ahead, behind = Window.partitionBy("row").orderBy("start", order), Window.partitionBy("row").orderBy(F.desc("start"), order.desc())
    before = F.max(F.when(base, F.col("end"))).over(ahead.rowsBetween(first, Window.currentRow))
    after = F.min(F.when(base, F.col("start"))).over(behind.rowsBetween(first, Window.currentRow))
    free = found.withColumn("before", before).withColumn("after", after).where(base | ((F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    earlier = F.max(F.when(~base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", F.desc("tier"), rank).rowsBetween(first, -1))
    return free.withColumn("earlier", earlier).where(base | F.col("earlier").isNull() | (F.col("earlier") <= F.col("start"))).drop("before", "after", "earlier")


def slots(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """pattern and tail, distinct: the words that stand right of one of the patterns.

    Lines are taken in stretches of ``STRETCH`` words, with one before and ``AHEAD`` after
    them, so that the row of a word that is looked up is short, however long its line.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.explode(F.split(text, "\n", -1)).alias("line"))
    said = lines.select(F.concat(F.array(F.lit("")), words(F.col("line"))).alias("w")).where(F.size("w") > 2)
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - 1, F.lit(STRETCH)), lambda k: F.slice(F.col("w"), k, STRETCH + 1 + AHEAD))
    stretch = said.select(F.explode(cut).alias("c"))

    def pattern(word: Column, k: Column) -> Column:
        before = F.col("c")[k]
        return F.when(F.substring(word, -1, 1).isin(":", "=", "#"), word).when(before != "", F.concat(before, F.lit(" "), word))

    placed = stretch.select("c", F.posexplode(F.transform(F.slice("c", 2, STRETCH), pattern)).alias("k", "pattern")).where("pattern is not null")
    found = placed.join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    return found.select("pattern", F.array_join(F.slice("c", F.col("k") + 3, F.lit(AHEAD)), " ").alias("tail")).where("tail <> ''").distinct()


def bootstrap(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Trusted (kind, pattern) with their scores, and the known (kind, key) at the end.

    A pattern is asked as soon as enough different known values follow it, and no sooner.
    A first look at one document in ``LOOK`` gives the least number of contents that its slot
    can have; if even all shapes after the pattern would be too small a share of that, it can
    never be trusted, and the whole corpus is not read for it.
    """
    placed, _ = written(found.where("pattern is not null").select("kind", "tier", "pattern", value_key(F.col("value")).alias("key")).groupBy("kind", "tier", "pattern", "key").agg(F.count("*").alias("n")), "pii-edges")
    shapes = placed.groupBy("kind", "pattern").agg(F.sum("n").alias("most"))
    edges = placed.select("kind", "pattern", "key").distinct()
    known, _ = written(placed.where("tier = 'base'").select("kind", "key").distinct(), "pii-known")
    asked = edges.limit(0).select("kind", "pattern")
    trusted = asked.withColumn("score", F.lit(0.0))
    begins = followers = None
    size = known.count()
    while True:
        enough = edges.join(known, ["kind", "key"], "left_semi").groupBy("kind", "pattern").agg(F.countDistinct("key").alias("n")).where(F.col("n") >= support).select("kind", "pattern")
        new, _ = written(enough.join(asked, ["kind", "pattern"], "left_anti"), "pii-asked")
        if new.limit(1).count():
            asked = asked.union(new)
            some = slots(docs.where(F.pmod(F.xxhash64(text), F.lit(LOOK)) == 0), new, text).groupBy("pattern").agg(F.count("*").alias("least"))
            hopeful, _ = written(new.join(shapes, ["kind", "pattern"]).join(some, "pattern", "left").where(F.col("most") >= confidence * F.coalesce("least", F.lit(0))).select("kind", "pattern"), "pii-hopeful")
            if hopeful.limit(1).count():
                held, _ = written(slots(docs, hopeful, text), "pii-slots")
                begun = F.split("tail", " ")
                keys = F.transform(F.sequence(F.lit(1), F.size(begun)), lambda k: F.regexp_replace(F.array_join(F.slice(begun, 1, k), " "), TAIL, ""))
                more, _ = written(held.select("pattern", "tail", F.explode(F.array_distinct(keys)).alias("key")).join(hopeful, "pattern"), "pii-begins")
                counts = held.join(hopeful, "pattern").groupBy("kind", "pattern").agg(F.count("*").alias("followers"))
                begins, followers = (more, counts) if begins is None else (begins.union(more), followers.union(counts))
        if begins is None:
            return trusted, known
        reached = begins.join(known, ["kind", "key"], "left_semi").groupBy("kind", "pattern").agg(F.countDistinct("key").alias("known_values"), F.countDistinct("tail").alias("known_tails"))
        scored = reached.join(followers, ["kind", "pattern"]).withColumn("confidence", F.col("known_tails") / F.col("followers"))
        trusted, _ = written(scored.where((F.col("known_values") >= support) & (F.col("confidence") >= confidence)).select("kind", "pattern", (F.col("confidence") * F.log2("known_values")).alias("score")), "pii-patterns")
        # An instance's score is that of its best trusted pattern; any trusted one will do.
        discovered = edges.join(trusted.select("kind", "pattern"), ["kind", "pattern"], "left_semi").select("kind", "key")
        known, _ = written(known.union(discovered).distinct(), "pii-known")
        size, was = known.count(), size
        if size == was:  # the known values only grow, and are finite
            return trusted, known


def open_spans(docs: DataFrame, everyone: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words that are no plain words and stand in the slot of a trusted pattern, with positions."""
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("t"))
    tokens = source.select("doc_id", "version", F.posexplode(hits(F.col("t"), WORD)).alias("pos", "h")).distinct()  # equal rows are looked at once
    order = Window.partitionBy("doc_id", "version").orderBy("pos")
    end = F.sum(F.col("h.gap") + F.col("h.len")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The words before a word, on its line: what is left of it, up to the last match.
    fresh = F.col("h.left").contains("\n")
    word = F.lower("h.value")
    one = F.when(~fresh, F.lag(word).over(order))
    two = F.when(~fresh & ~F.lag(fresh).over(order), F.lag(word, 2).over(order))
    placed = tokens.select("doc_id", "version", (end - F.col("h.len")).alias("start"), F.col("h.value").alias("value"), _pattern(F.filter(F.array(two, one), lambda w: w.isNotNull())).alias("pattern"))
    trimmed = F.regexp_replace("value", TAIL, "")
    some = placed.where(F.col("pattern").isNotNull() & trimmed.rlike(NO_WORD)).join(trusted.select("kind", "pattern"), "pattern")
    spans_ = some.withColumn("end", F.col("start") + F.length(trimmed))
    rows = everyone.withColumnRenamed("doc_id", "d").withColumnRenamed("version", "v")
    return spans_.join(rows, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v"))).select("row", F.lit("open").alias("tier"), "kind", "start", "end", "value", "pattern")


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts of base spans, checksum of the base, all spans, spans added."""
    everyone, found = spans(docs, doc_id, text)
    trusted, known = bootstrap(docs, found, text)
    wide = found.where("tier <> 'base' and pattern is not null").withColumn("key", value_key(F.col("value")))
    wide = wide.join(trusted.select("kind", "pattern"), ["kind", "pattern"], "left_semi").join(known, ["kind", "key"], "left_semi")
    columns = ("row", "tier", "kind", "start", "end")
    kept = found.where("tier = 'base'").select(*columns).union(wide.select(*columns))
    if trusted.limit(1).count():
        kept = apart(kept.union(open_spans(docs, everyone, trusted, doc_id, text).select(*columns)))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", rank.alias("rank"), "end", "tier", F.concat_ws(":", "kind", "start", "end").alias("said"))
    base = F.col("tier") == "base"
    grouped = kept.groupBy("row").agg(
        *[F.count(F.when(base & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS],
        F.count(F.when(~base, 1)).alias("n_added"),
        F.array_sort(F.collect_list(span)).alias("all"),
    )
    said = F.array_join(F.transform("all", lambda x: x["said"]), ",")
    said_base = F.array_join(F.transform(F.filter("all", lambda x: x["tier"] == "base"), lambda x: x["said"]), ",")
    return everyone.join(grouped, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(said_base, F.lit("")), 256).alias("base_sha256"),
        F.coalesce(said, F.lit("")).alias("spans"),
        F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents").select("doc_id", "text"))
