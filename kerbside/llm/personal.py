"""Personal data by patterns and by bootstrapped contextual extraction, in DataFrame operations only.

The seeds are what the base patterns find, each with its full value. Outside
of them every token holding a digit or an at sign, with the number pieces that
follow it, is a possible identifier. The two words before one are its lexical
pattern, in which identifiers count as a word that is the same for all. Patterns and tokens form a bipartite graph with one edge per pair
seen anywhere. Scores run over the graph in rounds: seeds have score 1, a
pattern scores the mean of its tokens, a token that looks like an identifier
scores what remains after each of its reliable patterns has failed to vouch
for it. What a round brings in counts as evidence for further patterns in the
next, until nothing changes. Tokens that reliable patterns bring in are
personal data too, wherever such a pattern precedes them.

Texts are scanned once; what follows works on the tokens found. Edges are
counted before they are shuffled, so a pattern or token of any frequency is
one row per partner, and joins split frequent keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.joins import skew_join
from kerbside.session import materialise, working_tables

# The base kinds in order. Possessive forms match the same text without backtracking.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_PIECE = r"^\(?[0-9][0-9()./-]*[0-9][0-9()./-]*[.,;:!?]*$"  # at least two digits
_LAST = r"(?:^\s*+|(?<!\S)(?:\S++\s++)?\S++\s*+)\z"  # up to two words at the end of a gap
CONTEXT = "context"

MIN_SEEDS = 5            # different seeds or vouched tokens that must follow a pattern
MIN_CONFIDENCE = 0.9     # of a pattern, and of a token it brings in
SETTLED = 1e-4           # rounds end when the confidences rise by less in all
_NUMBER = "0"            # stands for a token among the words; no other word has a digit
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string,before:string>>"
_UNITS = "array<struct<start:bigint,end:bigint,token:string,pattern:string,seed:int,runs:boolean>>"
_STATE = f"struct<covered:bigint,words:string,pattern:string,last:string,units:{_UNITS}>"


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points; those of tokens with the end of the gap before them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["value"])
        span = F.struct(
            F.lit(kind).alias("kind"), begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"),
            pair["value"].alias("value"), (F.regexp_extract(pair["gap"], _LAST, 0) if kind == CONTEXT else F.lit("")).alias("before"))
        return F.struct(end.cast("bigint").alias("at"), F.array_append(done["spans"], span).cast(_SPAN).alias("spans"))

    # split gives one more gap than there are matches; the last one is dropped
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda done: done["spans"])).otherwise(
        F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _proper(span: Column) -> Column:
    value, digits = span["value"], _digits(span["value"])
    size = F.length(digits)
    return (
        F.when(span["kind"] == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(span["kind"] == "card", size.between(12, 19) & F.call_function("luhn_check", digits))
        .when(span["kind"] == "phone", size.between(9, 15))
        .otherwise(F.lit(True))
    )


def _units(base: Column, tokens: Column) -> Column:
    """Instances with the two words before each, in the whole text, in order.

    A checked base span is one instance (seed 1) with the words before the
    word it begins in; of overlapping spans the first, then longest, counts.
    Any other token that touches no span is a candidate (seed 0), and number
    pieces that follow it at one blank belong to it. A span or a token and
    its pieces is one word ``_NUMBER`` to what comes after.
    """
    def event(kind: int):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("seed"), (-s["end"]).alias("minus_end"),
            s["value"].alias("value"), s["before"].alias("before"))

    def last_two(*words: Column) -> Column:
        return F.substring_index(F.trim(F.concat_ws(" ", *words)), " ", -2)

    def step(done: Column, e: Column) -> Column:
        span, end, units = e["seed"] == 1, -e["minus_end"], done["units"]
        inside = e["start"] < done["covered"]  # a span begun in an earlier word goes on here
        tail = F.trim(F.regexp_replace(F.lower(e["before"]), r"\s+", " "))
        pattern = F.when(span, done["pattern"]).when(inside, done["words"]).otherwise(last_two(done["words"], tail))
        runs = ~span & (e["before"] == " ") & e["value"].rlike(_PIECE) & done["last"].rlike("[0-9)]$")
        unit = F.struct(e["start"].alias("start"), end.alias("end"), e["value"].alias("token"), pattern.alias("pattern"),
                        e["seed"].alias("seed"), runs.alias("runs"))
        newest = F.get(units, F.size(units) - 1)
        touched = span & (newest["seed"] == 0) & (newest["end"] > e["start"])
        clear = F.when(touched, F.slice(units, F.lit(1), F.size(units) - 1)).otherwise(units)
        return F.struct(
            F.when(span, F.greatest(done["covered"], end)).otherwise(done["covered"]).alias("covered"),
            F.when(span | inside | runs, done["words"]).otherwise(last_two(pattern, F.lit(_NUMBER))).alias("words"),
            pattern.alias("pattern"), F.when(span, done["last"]).otherwise(e["value"]).alias("last"),
            F.when(inside, clear).otherwise(F.array_append(clear, unit)).alias("units")).cast(_STATE)

    def join(done: Column, u: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        whole = F.struct(
            last["start"].alias("start"), u["end"].alias("end"), F.concat_ws(" ", last["token"], u["token"]).alias("token"),
            last["pattern"].alias("pattern"), u["seed"].alias("seed"), u["runs"].alias("runs"))
        follows = u["runs"] & (u["seed"] == 0) & (last["seed"] == 0) & (last["end"] + 1 == u["start"])
        return F.when(follows, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), whole)).otherwise(
            F.array_append(done, u)).cast(_UNITS)

    events = F.array_sort(F.concat(F.transform(tokens, event(0)), F.transform(base, event(1))))
    empty = F.array().cast(_UNITS)
    start = F.struct(
        F.lit(0).alias("covered"), F.lit("").alias("words"), F.lit("").alias("pattern"), F.lit("").alias("last"),
        empty.alias("units")).cast(_STATE)
    return F.aggregate(F.aggregate(events, start, step, lambda done: done["units"]), empty, join)


def _scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, tokens) per document; the only pass over the texts."""
    text = F.col("text")
    none = F.array().cast(_SPAN)

    def found(needs: Column, pattern: str, kind: str) -> Column:
        return F.when(needs, _matches(text, pattern, kind)).otherwise(none)

    digit = text.rlike("[0-9]")
    base = F.concat(
        found(text.contains("@"), _EMAIL, "email"),
        found(digit & text.contains("."), _IP, "ip"),
        found(digit, _CARD, "card"),
        found(digit & text.contains("+"), _PHONE, "phone"),
    )
    tokens = found(digit | text.contains("@"), _TOKEN, CONTEXT)
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.filter(base, _proper).alias("base"), tokens.alias("tokens"),
    ).select(
        "row", "doc_id", F.transform("base", lambda s: s.dropFields("value", "before")).alias("base"),
        _units(F.col("base"), F.col("tokens")).alias("tokens"))


def _scores(edges: DataFrame, rounds: int | None, min_seeds: int, min_confidence: float) -> DataFrame:
    """(pattern, token) of the tokens that reliable patterns bring in, from (pattern, token, seed) edges.

    A pattern is reliable if ``min_seeds`` of its tokens are seeds or vouched
    for, and its tokens score ``min_confidence`` on average. Scores only rise,
    so rounds end when no pattern is added and no score moves any more.
    """
    shape = (F.col("token").contains("@") | (F.length(_digits(F.col("token"))) >= 3)) & (F.length("token") >= 6)
    possible = ((F.col("seed") == 1) | shape).cast("int")
    # no score can lift the other patterns over the bounds
    hopeful = edges.groupBy("pattern").agg(F.sum(possible).alias("n"), F.avg(possible).alias("share")).where(
        (F.col("n") >= min_seeds) & (F.col("share") >= min_confidence)).select("pattern")
    graph = materialise(
        skew_join(edges, hopeful, ["pattern"]).select("pattern", "token", "seed", possible.alias("possible")), "graph")
    scores = materialise(graph.groupBy("token").agg(F.max("seed").cast("double").alias("score")), "token-scores")
    turn, before = 0, (0, 0.0)
    while True:
        turn += 1
        sure = F.col("score") >= min_confidence
        patterns = materialise(
            skew_join(graph, scores, ["token"]).groupBy("pattern")
            .agg(F.avg("score").alias("confidence"), F.count_if(sure).alias("support"))
            .where((F.col("support") >= min_seeds) & (F.col("confidence") >= min_confidence)), "patterns")
        now = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if turn == rounds or (now[0] == before[0] and now[1] - before[1] < SETTLED):
            break
        before = now
        vouched = skew_join(graph, patterns, ["pattern"], "left")
        unsure = F.when(F.col("confidence").isNotNull(), F.greatest(1 - F.col("confidence"), F.lit(1e-12)))
        doubt = F.coalesce(F.sum(F.log(unsure)), F.lit(0.0))
        scores = materialise(
            vouched.groupBy("token").agg(F.max("seed").alias("seed"), F.max("possible").alias("possible"), doubt.alias("doubt"))
            .select("token", F.when(F.col("seed") == 1, 1.0).when(F.col("possible") == 1, 1 - F.exp("doubt"))
                    .otherwise(0.0).alias("score")),
            "token-scores",
        )
    return skew_join(graph, patterns, ["pattern"]).where("seed = 0 AND possible = 1").select("pattern", "token")


def find(
    docs: DataFrame, rounds: int | None = None, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """(doc_id, base, context): base spans and spans found by context, arrays of (kind, start, end).

    Places are code points, end exclusive. Matches of a base kind are leftmost
    and do not overlap; those that fail their check are dropped and not tried
    again. Context spans never overlap base spans. Null and empty texts have no
    spans, repeated rows are reported each but count once as evidence, an
    empty table gives no rows. ``rounds`` may bound the rounds of scoring.
    """
    with working_tables() as keep:
        scanned = materialise(_scanned(docs), "scanned")
        seen = scanned.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select(
            "row", "t.start", "t.end", "t.token", "t.pattern", "t.seed").where(F.col("pattern").contains(" "))
        edges = materialise(seen.groupBy("pattern", "token").agg(F.max("seed").alias("seed")), "edges")
        accepted = materialise(_scores(edges, rounds, min_seeds, min_confidence), "accepted")
        spans = (
            skew_join(seen.where("seed = 0"), accepted, ["pattern", "token"])
            .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
                F.lit(CONTEXT).alias("kind"), "start", "end"))).alias("context"))
        )
        result = materialise(
            scanned.select("row", "doc_id", "base").join(spans, "row", "left")
            .select("doc_id", "base", F.coalesce("context", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("context")),
            "personal",
        )
        keep.append(result)
    return result


def _listed(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, by start and then by the order of the kinds."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; cases as in ``find``."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find(docs).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_listed(F.col("base"), KINDS), 256).alias("base_sha256"),
        _listed(F.concat("base", "context"), (*KINDS, CONTEXT)).alias("spans"),
    )
