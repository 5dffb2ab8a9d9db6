"""Personal data: patterns, and terms that give an entity away.

Four kinds are found by pattern. Beyond them, the corpus tells which terms
disclose a found entity: over distinct lines, how often a term stands with the
entity against how often it stands at all. A term is a span of kind ``term``
in every document that holds the entity if it stands with it in at least
``LEAST_LINES`` distinct lines, tells it with a chance of at least
``LEAST_CHANCE``, and with at least ``LEAST_BITS`` bits of pointwise mutual
information. A term stands with an entity if it is in the same line, with no other
match of the entity's kind between. DataFrame operations only.

Matches are leftmost and don't overlap within a kind; those that fail a check
are dropped. The patterns are written so that matching takes linear time and
no deep recursion: possessive repeats, and starts only where a run of the first
class starts or the match before ended. Positions count code points. Null and
empty texts have no spans. Repeated rows each have their spans. Other columns
don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestige.llm.shared import let, own_columns, plus, running, stash, whole_text

KINDS = ["email", "ip", "card", "phone", "term"]
# The contract's patterns, in a form of linear time.
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # The whole run of digits, and only runs of 12 to 19.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match, and is quickly looked for.
HINTS = {"email": "@", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
LEAST_LINES, LEAST_CHANCE, LEAST_BITS = 5, 0.5, 4.0
TAGS = {kind: f"<{kind.upper()}>" for kind in KINDS}
LETTERS = r"[^\p{L}]+"
SPAN = "array<struct<start:int,rank:int,end:int>>"
MATCHES = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
SIEVE = 1 << 16
#: Terms up to which the exact terms are broadcast.
MOST_BROADCAST = 50_000
#: Parts that the copies of one text are dealt over.
SALTS = 32


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass Luhn's check."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))

    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    n = F.length(F.regexp_replace(match, "[^0-9]", ""))
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return n.between(12, 19) & luhn(match)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def placed_matches(text: Column, pattern: Column) -> Column:
    """Array of (start, end, value, before, after) of all matches; before and after are the gaps beside a match, in its line."""

    def place(found: Column) -> Column:
        gaps, matches = found["gaps"], found["matches"]
        sizes = F.transform(matches, lambda m, i: (F.length(F.get(gaps, i)) + F.length(m)).cast("int"))

        def at(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(starts, i) + F.length(F.get(gaps, i))
                before, after = F.substring_index(F.get(gaps, i), "\n", -1), F.substring_index(F.get(gaps, i + 1), "\n", 1)
                return F.struct(start.cast("int").alias("start"), (start + F.length(m)).cast("int").alias("end"), m.alias("value"), before.alias("before"), after.alias("after"))

            return F.transform(matches, one)

        return let(running(sizes, plus), at)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches")), place)


def _checker(kind: str):
    return lambda m: passes(kind, m["value"])


def _spanner(rank: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))


def _entity(kind: str):
    """The entity of a match and the words beside it: of its line, up to the matches of its kind before and after."""

    def pair(m: Column) -> Column:
        return F.struct(F.concat(F.lit(kind + ":"), F.lower(m["value"])).alias("entity"), F.concat_ws(" ", m["before"], m["after"]).alias("line"))

    return pair


def with_matches(docs: DataFrame) -> DataFrame:
    """``docs`` with an array column of good matches for each base kind (see ``placed_matches``)."""
    none = F.array().cast(MATCHES)
    for kind, pattern in PATTERNS.items():
        hint = F.col("text").contains(HINTS[kind]) if kind in HINTS else F.col("text").rlike(pattern)
        found = F.filter(placed_matches(F.col("text"), F.lit(pattern)), _checker(kind))
        docs = docs.withColumn(kind, F.when(hint, found).otherwise(none))
    return docs


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans() -> Column:
    return F.concat(*[F.transform(kind, _spanner(rank)) for rank, kind in enumerate(PATTERNS)])


def base_entities(docs: DataFrame, all_texts: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, doc_hash, counts, spans, for each span its entity and the rest of its line, the text (of rows without spans only with ``all_texts``), and ``carry``."""
    entities = F.concat(*[F.transform(kind, _entity(kind)) for kind in PATTERNS])
    found = with_matches(docs).select("doc_id", *carry, "doc_hash", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], base_spans().alias("spans"), entities.alias("entities"), "text")
    return found if all_texts else found.withColumn("text", F.when(F.size("spans") > 0, F.col("text")))


def disclosing_terms(base: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(entity, term) of the terms that give entities away; None if there are none."""
    held = base.where(F.size("entities") > 0).select(F.explode("entities").alias("e")).select("e.entity", "e.line")
    counted = held.groupBy("entity", "line").agg(F.count("*").alias("n"))
    often = counted.groupBy("entity").agg(F.count("*").alias("lines"), F.sum("n").alias("n_entity")).where(F.col("lines") >= LEAST_LINES)
    terms = F.array_distinct(F.filter(F.split(F.lower("line"), LETTERS), lambda w: F.length(w) > 1))
    together = counted.join(often.select("entity", "n_entity"), "entity").select("entity", "n_entity", "n", F.explode(terms).alias("term"))
    both = together.groupBy("entity", "term").agg(F.count("*").alias("lines"), F.sum("n").alias("n_both"), F.first("n_entity").alias("n_entity")).where(F.col("lines") >= LEAST_LINES)
    # A term is in at least as many lines as documents have it beside any entity: that alone rules out common words.
    beside = F.array_distinct(F.flatten(F.transform("entities", lambda e: F.split(F.lower(e["line"]), LETTERS))))
    least = base.where(F.size("entities") > 0).select(F.explode(beside).alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    likely = stash(both.join(least, "term").where(F.col("n_both") >= LEAST_CHANCE * F.col("least")).drop("least"), "pii-likely")
    if likely.isEmpty():
        return None
    # How many lines of the corpus hold each such term. Few terms are broadcast; of many, a table of at most 2^16 hash values
    # keeps most other words out.
    wanted = likely.select("term").distinct()
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select(F.explode(F.array_distinct(F.split(F.lower("line"), LETTERS))).alias("term"))
    if wanted.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    else:
        sieve = F.pmod(F.xxhash64("term"), F.lit(SIEVE))
        words = words.withColumn("sieve", sieve).join(F.broadcast(wanted.select(sieve.alias("sieve")).distinct()), "sieve", "left_semi")
    words = words.groupBy("term").agg(F.count("*").alias("n_term"))
    n_lines = docs.select(F.sum(F.size(F.split("text", "\n")))).first()[0]
    chance = F.col("n_both") / F.col("n_term")
    bits = F.log2(chance * F.lit(float(n_lines)) / F.col("n_entity"))
    return stash(likely.join(words, "term").where((chance >= LEAST_CHANCE) & (bits >= LEAST_BITS)).select("entity", "term"), "pii-terms")


def with_term_spans(base: DataFrame, terms: DataFrame) -> DataFrame:
    """``base`` with the spans of the terms that give its own entities away.

    The terms of a text are found once for all its copies; copies are dealt out
    over ``SALTS`` parts, so that no text's copies meet in one task.
    """
    held = base.where(F.size("entities") > 0)
    entities = held.select("doc_hash", F.explode("entities.entity").alias("entity")).distinct()
    wanted = stash(entities.join(terms, "entity").groupBy("doc_hash").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms")), "pii-wanted")
    everywhere = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.col("terms"), F.lit(r")(?!\p{L})"))
    found = F.transform(placed_matches(F.col("text"), pattern), _spanner(KINDS.index("term")))
    named = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(everywhere, ["doc_hash", "salt"], "left")
    named = named.withColumn("term_spans", F.when(F.col("terms").isNotNull(), found).otherwise(_no_spans())).drop("salt", "terms")
    return named.unionByName(base.where(F.size("entities") == 0).withColumn("term_spans", _no_spans()))


def _no_spans() -> Column:
    return F.array().cast(SPAN)


def text_hash() -> Column:
    """128 bits, so that no two texts of a corpus of any size share theirs by chance."""
    return F.unhex(F.md5("text"))


def find(docs: DataFrame, carry: tuple[str, ...] = (), all_texts: bool = False) -> DataFrame:
    """doc_id, n_email ... n_phone, spans (base), term_spans of every row of ``docs``, the columns of ``carry``, and the text of rows with spans, or of all."""
    own = own_columns(docs, "doc_id", "text", *carry).withColumn("text", whole_text()).withColumn("doc_hash", text_hash())
    base = stash(base_entities(own, all_texts, carry), "pii-base")
    terms = disclosing_terms(base, own)
    if terms is None or terms.isEmpty():
        return base.withColumn("term_spans", _no_spans())
    return with_term_spans(base, terms)


def span_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of every row of ``docs``."""
    found = find(docs)
    counts = [f"n_{k}" for k in PATTERNS]
    return found.select("doc_id", *counts, F.size("term_spans").cast("long").alias("n_term"), F.sha2(spans_text(F.col("spans")), 256).alias("base_sha256"), spans_text(F.concat("spans", "term_spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's tag; overlapping spans are replaced as one, by the first one's."""
    tags = F.array(*[F.lit(TAGS[k]) for k in KINDS])

    # Four bytes for each code point, so that a piece is cut out without walking over the text before it.
    def piece(wide: Column, start: Column, size: Column) -> Column:
        return F.decode(F.substr(wide, 4 * start + 1, 4 * size), "UTF-32")

    def build(found: Column) -> Column:
        wide, ordered = found["wide"], found["ordered"]

        def pieces(ends: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                end = F.get(ends, i)
                return F.when(s["start"] >= end, F.concat(piece(wide, end, s["start"] - end), F.get(tags, s["rank"]))).otherwise("")

            last = F.array_max(F.transform(ordered, lambda s: s["end"]))
            return F.concat(F.array_join(F.transform(ordered, one), ""), piece(wide, last, F.length(text) - last))

        return let(running(F.transform(ordered, lambda s: s["end"]), F.greatest), pieces)

    done = let(F.struct(F.encode(text, "UTF-32").alias("wide"), F.sort_array(spans).alias("ordered")), build)
    return F.when(F.size(spans) == 0, text).otherwise(done)


def sanitise(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (spans replaced by tags) of every row of ``docs``, and the columns of ``carry``."""
    found = find(docs, carry, all_texts=True)
    return found.select("doc_id", *carry, redacted(F.col("text"), F.concat("spans", "term_spans")).alias("text"))
