"""Personal data: base patterns, and bootstrapped extraction of identifiers that the patterns miss.

Base spans are leftmost, non-overlapping matches per kind that pass the kind's check. Their texts are the seeds of
the bootstrap: the word before a seed is a lexical pattern for the seed's kind. Looser number runs and addresses
are candidate instances. On the graph of patterns and instances a pattern scores by the share of its occurrences
that are instances of its kind, an instance by the chance that not all of its patterns are wrong, and the scores
are iterated. Candidates that reach ``ACCEPT`` through patterns with ``MIN_SEEDS`` different seeds, and whose form
is plausible for the kind, become spans of that kind.

Only DataFrame functions are used. Each text is read once; everything after that works on narrow tables of spans,
summed per (pattern, instance) before they are joined. Start places come from the lengths of the pieces between
matches. Repetitions are only of single character classes, so texts of any length are matched without recursion.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows get equal spans; rows are
told apart by id and text, so ids may repeat or be null; an empty table gives an empty result; other columns pass
through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Workspace

KINDS = ("email", "ip", "card", "phone")
REACH = 48  # characters before a span in which its pattern is looked for
ROUNDS = 3
SMOOTH = 1.0  # occurrences of doubt added to each pattern
MIN_SEEDS = 5
ACCEPT = 0.9
BROADCAST_ROWS = 200_000
LINK = "\u0001"  # stands for a separator between two parts of one identifier
_SPAN = "struct<start:bigint,end:bigint,value:string,context:string>"


def _linked(text: Column, pattern: str) -> Column:
    """The text with each character that the pattern matches replaced by ``LINK``, at unchanged places."""
    return F.regexp_replace(F.translate(text, LINK, "\u0002"), pattern, LINK)


def _matches(text: Column, searched: Column, pattern: str, ok) -> Column:
    """Spans of all matches in ``searched``, a version of ``text`` with equal places, whose text passes ``ok``."""
    pieces = F.split(searched, pattern, -1)
    hits = F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
    steps = F.filter(F.zip_with(pieces, hits, lambda p, h: F.struct(p.alias("p"), h.alias("h"))), lambda x: x.h.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc.at + F.length(x.p)
        end = begin + F.length(x.h)
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

    places = F.aggregate(steps, start, step, lambda acc: acc.out)

    def span(x: Column) -> Column:
        near = F.substr(text, F.greatest(x.start - REACH, F.lit(0)) + 1, F.least(x.start, F.lit(REACH)))
        return F.struct(x.start.alias("start"), x.end.alias("end"),
                        F.substr(text, x.start + 1, x.end - x.start).alias("value"),
                        F.lower(F.regexp_extract(near, r"([^\s(]+)[\s(]*$", 1)).alias("context"))

    return F.filter(F.transform(places, span), lambda x: ok(x.value))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _is_ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*[0-9]{1,3}$") & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))


def _is_card(value: Column) -> Column:
    """12 to 19 digits with a Luhn sum divisible by ten."""
    d = F.reverse(_digits(value))

    def weigh(acc: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    luhn = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), weigh) % 10 == 0
    return F.when(F.length(d).between(12, 19), luhn).otherwise(False)


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(9, 15)


def _none() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind."""
    local = f"A-Za-z0-9._%+{LINK}-"
    # Where a run of local-part characters fails at its start it fails everywhere, so it is tried once.
    mail = f"(?:(?<![{local}])|\\G)[{local}]++@[A-Za-z0-9-]++{LINK}[A-Za-z0-9{LINK}-]+"
    dotted = _linked(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])")
    spaced = _linked(text, r"(?<=[0-9])[\x20-](?=[0-9])")
    ip = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    yes = lambda value: F.lit(True)
    return {
        "email": F.when(text.contains("@"), _matches(text, dotted, mail, yes)).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), _matches(text, text, ip, _is_ip)).otherwise(_none()),
        "card": F.when(text.rlike(r"[0-9]"), _matches(text, spaced, f"[0-9{LINK}]{{2,}}", _is_card)).otherwise(_none()),
        "phone": F.when(text.contains("+"), _matches(text, text, phone, _is_phone)).otherwise(_none()),
    }


def _candidates(text: Column) -> Column:
    """Numbers of 7 to 19 digits with any separators, and addresses without a dotted domain."""
    sep = r"[\x20().-]"
    close = _linked(text, f"(?<=[0-9]){sep}(?=[0-9])|(?<=[0-9]{sep}){sep}(?=[0-9])|(?<=[0-9]){sep}(?={sep}[0-9])")
    number = _matches(text, close, f"[0-9{LINK}]{{7,}}", lambda v: F.length(_digits(v)).between(7, 19))
    local = "A-Za-z0-9._%+-"
    mail = _matches(text, text, f"(?:(?<![{local}])|\\G)[{local}]++@[A-Za-z0-9-]+", lambda v: F.lit(True))
    return F.concat(F.when(text.rlike("[0-9]"), number).otherwise(_none()),
                    F.when(text.contains("@"), mail).otherwise(_none()))


def _plausible(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    return F.when(kind == "email", value.contains("@")).when(kind == "card", n.between(12, 19)) \
        .when(kind == "phone", n.between(7, 15)).otherwise(value.rlike(r"[0-9]+\D[0-9]+\D[0-9]+\D[0-9]+"))


def _tagged(rank: int, kind: str) -> Column:
    return F.transform(kind, lambda x: F.struct(
        x.start.alias("start"), F.lit(rank).alias("rank"), x.end.alias("end"), F.lit(kind).alias("kind"),
        x.value.alias("value"), x.context.alias("context")))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long")


def scan(df: DataFrame, doc_id: str, text: str, carry: list[str], work: Workspace) -> DataFrame:
    """One pass over the texts: ``id``, ``version`` (a hash of the text), the ``row`` of carried columns, the
    ``base`` spans with their kind, and the ``loose`` candidates that touch none of them."""
    rows = df.select(F.struct(F.lit(1).alias("_"), *carry).alias("row"), F.col(doc_id).alias("id"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("row", "id", F.xxhash64("text").alias("version"), *[s.alias(k) for k, s in base_spans(F.col("text")).items()],
                       _candidates(F.col("text")).alias("loose"))
    tagged = [_tagged(i, k) for i, k in enumerate(KINDS)]
    rows = rows.select("row", "id", "version", F.array_sort(F.concat(*tagged)).alias("base"), "loose")
    free = F.filter("loose", lambda c: ~F.exists("base", lambda b: (c.start < b.end) & (b.start < c.end)))
    return work.save(rows.withColumn("loose", F.when(F.size("loose") > 0, free).otherwise(F.col("loose"))), "spans")


def bootstrap(spans: DataFrame, work: Workspace) -> DataFrame:
    """``value, kind, score`` of the accepted unseen identifiers."""
    seeds = spans.select(F.explode("base").alias("s")).select("s.context", "s.value", "s.kind")
    loose = spans.select(F.explode("loose").alias("s")).select("s.context", "s.value", F.lit("").alias("kind"))
    edges = seeds.union(loose).filter("context <> ''").groupBy("context", "value", "kind").agg(F.count("*").alias("n"))
    edges = work.save(edges, "edges")
    # Only patterns that have enough seeds and precede a candidate can discover anything.
    useful = edges.groupBy("context").agg(F.count_if(F.col("kind") != "").alias("seeds"), F.count_if(F.col("kind") == "").alias("new"),
                                          F.sum("n").alias("total"))
    useful = work.save(useful.filter((F.col("seeds") >= MIN_SEEDS) & (F.col("new") > 0)).select("context", "total"), "patterns")
    edges = work.save(edges.join(useful, "context"), "graph")
    known = edges.filter("kind <> ''").groupBy("context", "total", "kind").agg(F.sum("n").alias("mass"))
    known = work.save(known, "seeded")
    fresh = edges.filter("kind = ''").select("context", "value", "n", "total")
    score = None
    for _ in range(ROUNDS):
        mass = known
        if score is not None:
            found = fresh.join(score, "value").groupBy("context", "total", "kind").agg(F.sum(F.col("n") * F.col("score")).alias("mass"))
            mass = known.unionByName(found).groupBy("context", "total", "kind").agg(F.sum("mass").alias("mass"))
        pattern = mass.select("context", "kind", (F.col("mass") / (F.col("total") + SMOOTH)).alias("p"))
        pattern = work.save(pattern, "scores")
        score = work.save(fresh.join(pattern, "context").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score")), "instances")
    best = score.filter((F.col("score") >= ACCEPT) & _plausible(F.col("kind"), F.col("value")))
    return best.groupBy("value").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))


def find(df: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None,
         work: Workspace | None = None) -> DataFrame:
    """The carried columns of each row, with its ``base`` spans and the ``added`` ones, each sorted by start and kind.

    A span is a struct of start, rank (place of its kind in ``KINDS``), end, kind, value and context.
    """
    carry = [doc_id] if carry is None else carry
    work = work or Workspace(df.sparkSession, "pii")
    spans = scan(df, doc_id, text, carry, work)
    accepted = work.save(bootstrap(spans, work), "accepted")
    loose = spans.select("id", "version", F.explode("loose").alias("s")).select("id", "version", "s.*")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    added = loose.distinct().join(accepted, "value").select("id", "version", F.struct(
        "start", rank.alias("rank"), "end", "kind", "value", "context").alias("s"))
    added = work.save(added.groupBy("id", "version").agg(F.array_sort(F.collect_list("s")).alias("added")), "added")
    if added.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        added = F.broadcast(added)
    met = spans.alias("s").join(
        added.alias("a"), F.col("s.id").eqNullSafe(F.col("a.id")) & (F.col("s.version") == F.col("a.version")), "left")
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string,context:string>>)")
    return met.select(*[F.col("s.row")[c].alias(c) for c in carry], "base", F.coalesce("added", none).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by ``[KIND]`` of its first kind."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array(F.lit("")).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.array(F.substr(text, acc.at + 1, x.start - acc.at), F.concat(F.lit("["), F.upper(x.kind), F.lit("]")))
        return F.struct(F.greatest(acc.at, x.end).alias("at"),
                        F.when(x.start >= acc.at, F.concat(acc.out, new)).otherwise(acc.out).alias("out"))

    rest = F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substr(text, acc.at + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
