r"""PII by bootstrapped contextual extraction, in DataFrame operations only.

Base. Four expressions find emails, IP addresses, card and phone numbers, leftmost and without
overlaps within a kind; matches that fail a check (parts over 255, digits, Luhn) are dropped. A fifth
finds credentials: the values of named assignments (password=..., token = "...") and keys of known
forms, kind `secret`. The expressions are anchored to the starts of their runs and possessive, so they
match what the plain ones do in time linear in the text. Places come from the lengths of the matches
and of what a split at them leaves, in code points, summed up by a scan of log2(n) steps over the array.

Bootstrapping. Candidates are words with a digit, SHORTEST characters at least, each with the last
run of letters before it, with the `:` or `=` behind that (its context). Candidates that overlap a
span are the seeds; those that overlap a match which failed its check are refused: they count
against their patterns and are never found. A context must name identifiers: of its occurrences in
all texts, RATE at least are followed by a candidate. Patterns are (context, shape) and (context, any
shape); shapes keep signs, letters become a and digits 9, long hexadecimal words are h. On the graph
of patterns and instances, a pattern's score is the mean score of its distinct instances; a seed
scores 1, a refused instance 0, and any other 1 - product(1 - score) over its patterns, damped. A
pattern is on the graph once SUPPORT of its distinct instances are seeds or have scored CONFIDENCE, so
what one pattern finds supports others, over any number of hops. Rounds are checkpointed and end ROUNDS
after the last new pattern. Patterns of CONFIDENCE discover: their other candidates become spans of
kind `id`; all patterns with that score do, so ties need no rule.

Edge cases: a null text counts as empty, which has no spans; repeated rows get the same result each;
rows without a doc_id are handled like others; an empty table gives an empty result; a number that
is a card as well as part of a phone number is both, as kinds are independent; other columns are
ignored by `find` and kept by `redact`, where overlapping spans become one of the first one's kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquern.llm.common import cut

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_NAMED = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?"
_FORMS = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36}|[sr]k_live_[A-Za-z0-9]{16}"
SECRET = rf"(?<![A-Za-z0-9])(?:{_NAMED}|(?={_FORMS}))((?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{{8,}}+)"
CANDIDATE = r"(?<!\S)(\S++(?:[ \t]++[=:]++)?+)[ \t]++(?=([^\s0-9]*+[0-9]\S*+))"
#: A run of letters with the sign of an assignment.
RUN = r"\p{L}++(?:[\"')\]]*+[ \t]*+[:=])?+"
_QUIET = "\"')] \t"
KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
#: Rounds of scoring after the last new pattern, least score, and least number of distinct instances that support a pattern.
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.6, 3
DAMPING = 0.8
#: Least share of a context's occurrences that a candidate follows, and least length of a candidate: shorter words identify nobody.
RATE, SHORTEST = 0.5, 4
#: Parts that hot patterns are split into when they are joined, and most rows of a side that is broadcast (counted first).
SALT, SMALL = 8, 50_000
#: Code points in a block of a text that is put together anew.
BLOCK = 1024
_PAIRS = "array<struct<start:int,end:int>>"
_POWERS = [1 << j for j in range(31)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, though a lambda in `body` uses it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array: each step joins what lies twice as far back, so n values take n log n."""

    def step(a: Column, k: Column) -> Column:
        return F.when(k < F.size(a), F.transform(a, lambda x, i: F.when(i >= k, combine(x, F.get(a, i - k))).otherwise(x))).otherwise(a)

    return F.aggregate(F.array(*(F.lit(k) for k in _POWERS)), values, step)


def _hits(text: Column, gate: Column, pattern: str, group: int = 0) -> Column:
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def _places(gaps: str, hits: str, value: str | None = None) -> Column:
    """Start, end and text of every hit, from the gaps between them; `value` are the ends of the hits that count."""
    lengths = F.zip_with(F.slice(F.col(gaps), F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h))
    kept = F.col(value or hits)

    def place(ends: Column) -> Column:
        return F.zip_with(ends, kept, lambda e, h: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(F.size(hits) > 0, _let(_scan(lengths, lambda x, y: x + y), place)).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """The check of card numbers, from the right."""

    def add(total: Column, x: Column) -> Column:
        d = x["d"].cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.struct((total["n"] + 1).alias("n"), (total["s"] + F.when(total["n"] % 2 == 1, twice).otherwise(d)).alias("s"))

    figures = F.transform(F.split(F.reverse(_digits(hit)), ""), lambda d: F.struct(d.alias("d")))
    figures = F.filter(figures, lambda x: x["d"] != "")
    return F.aggregate(figures, F.struct(F.lit(0).alias("n"), F.lit(0).alias("s")), add, lambda a: a["s"] % 10 == 0)


def _octets(hit: Column) -> Column:
    """Whether all parts are at most 255, whatever zeros they begin with."""
    return ~F.exists(F.split(hit, "\\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{4,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])$"))


def _ten_to_fifteen(hit: Column) -> Column:
    return F.length(_digits(hit)).between(10, 15)


CHECKS = {"ip": _octets, "card": _luhn, "phone": _ten_to_fifteen}


def _key() -> Column:
    """Tells rows apart that aren't copies of each other."""
    text = F.coalesce("text", F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.length(text).cast("string"))


def _run_of(before: Column) -> Column:
    """The last run of letters of what stands before a word."""
    return F.translate(F.regexp_extract(F.lower(before), rf"({RUN})[^\p{{L}}]*+$", 1), _QUIET, "")


def _candidate(x: Column) -> Column:
    """(start, end, before, core) of a word: an assignment inside it is its context, else the words before it are."""
    name = F.regexp_extract(x["word"], r"^([^\p{L}0-9]*+\p{L}[\p{L}_-]*+[\"')\]]*+[:=]++[\"'(\[]*+)(?=\S)", 1)

    def rest(w: Column) -> Column:
        lead = F.length(F.regexp_extract(w["rest"], "^[^0-9A-Za-z+@(]*+", 0))
        core = F.regexp_extract(w["rest"], "^[^0-9A-Za-z+@(]*+(.*?)[^0-9A-Za-z)]*$", 1)
        start = w["at"] + lead
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), _run_of(w["before"]).alias("before"), core.alias("core"))

    word = F.struct(
        (x["cand"]["end"] + F.length(name)).alias("at"),
        F.when(name == "", x["before"]).otherwise(name).alias("before"),
        F.substring(x["word"], F.length(name) + 1, F.length(x["word"])).alias("rest"),
    )
    return _let(word, rest)


def _with_state(candidates: Column, seeds: Column, refused: Column) -> Column:
    """The candidates with state 1 where they overlap a seed, -1 where only a refused match, else 0.

    Spans and candidates are put in one order; a running maximum of the spans' ends tells what overlaps.
    """
    event = lambda at, seed, no, c: F.struct(at.alias("at"), seed.alias("seed"), no.alias("no"), c.alias("c"))
    none = F.lit(None).cast("struct<start:int,end:int,before:string,core:string>")
    zero = F.lit(0)
    events = F.array_sort(F.concat(
        F.transform(seeds, lambda s: event(2 * s["start"], s["end"], zero, none)),
        F.transform(refused, lambda s: event(2 * s["start"], zero, s["end"], none)),
        F.transform(candidates, lambda c: event(2 * c["end"] - 1, zero, zero, c)),
    ))

    def judge(e: Column) -> Column:
        running = lambda name: _scan(F.transform(e, lambda x: x[name]), lambda x, y: F.greatest(x, y))
        marked = F.zip_with(e, F.arrays_zip(running("seed").alias("seed"), running("no").alias("no")), lambda x, m: F.struct(
            x["c"]["start"].alias("start"), x["c"]["end"].alias("end"), x["c"]["before"].alias("before"), x["c"]["core"].alias("core"),
            F.when(m["seed"] > x["c"]["start"], 1).when(m["no"] > x["c"]["start"], -1).otherwise(0).alias("state"),
        ))
        return F.filter(marked, lambda x: x["core"].isNotNull())

    empty = F.array().cast("array<struct<start:int,end:int,before:string,core:string,state:int>>")
    return F.when(F.size(candidates) > 0, _let(events, judge)).otherwise(empty)


def _spans(docs: DataFrame, candidates: bool = True) -> DataFrame:
    """The rows of docs (with a column text that isn't null) with email, ip, card, phone, secret and, if asked for, candidates."""
    text = F.col("text")
    number = text.rlike("[0-9]")
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "secret": SECRET} | ({"cand": CANDIDATE} if candidates else {})
    gates = {"email": text.contains("@"), "ip": number & text.contains("."), "card": number, "phone": text.contains("+"), "secret": number, "cand": number}
    found = docs.select("*", *(_hits(text, gates[k], p).alias(f"h_{k}") for k, p in patterns.items()))
    groups = {"value": (SECRET, "h_secret", 1)} | ({"before": (CANDIDATE, "h_cand", 1), "word": (CANDIDATE, "h_cand", 2)} if candidates else {})
    split = found.select(
        "*",
        *(F.when(F.size(f"h_{k}") > 0, F.split("text", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"g_{k}") for k, p in patterns.items()),
        *(_hits(text, F.size(h) > 0, p, g).alias(name) for name, (p, h, g) in groups.items()),
    )
    placed = split.select("*", *(_places(f"g_{k}", f"h_{k}", "value" if k == "secret" else None).alias(k) for k in patterns))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    passing = lambda k: bare(F.filter(k, lambda s: CHECKS[k](s["hit"])) if k in CHECKS else F.col(k))
    failing = lambda k: bare(F.filter(k, lambda s: ~CHECKS[k](s["hit"])))
    names = docs.columns
    if not candidates:
        return placed.select(*names, *(passing(k).alias(k) for k in FOUND))
    words = F.filter(F.transform(F.arrays_zip("cand", "before", "word"), _candidate), lambda c: F.length(c["core"]) >= SHORTEST)
    checked = placed.select(*names, *(passing(k).alias(k) for k in FOUND), words.alias("words"), F.flatten(F.array(*(failing(k) for k in CHECKS))).alias("refused"))
    return checked.select(*names, *FOUND, _with_state(F.col("words"), F.flatten(F.array(*FOUND)), F.col("refused")).alias("candidates"))


def base_spans(docs: DataFrame) -> DataFrame:
    """(key, doc_id, email, ip, card, phone, secret, candidates): spans of each kind, and candidates (start, end, before, core, state)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _key().alias("key"))
    return _spans(rows).drop("text")


def _shape(core: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(core, "[A-Za-z]+", "a"), "[0-9]", "9")
    return F.when(core.rlike("^(?=.*[a-f])[0-9a-f]{16,}$"), F.lit("h")).otherwise(plain)


def _pattern(before: Column, shape: Column) -> Column:
    """A pattern's name; long ones go by their hash."""
    name = F.concat_ws(" ", before, shape)
    return F.when(F.length(name) > 64, F.md5(name)).otherwise(name)


def _small(df: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def specific_contexts(rows: DataFrame, docs: DataFrame, support: int = SUPPORT, rate: float = RATE) -> DataFrame:
    """(before): contexts of `support` distinct candidates whose occurrences in all texts a candidate follows in `rate` of cases."""
    words = rows.groupBy("before", "core").agg(F.count("*").alias("k"))
    contexts = cut(words.groupBy("before").agg(F.sum("k").alias("hits"), F.count("*").alias("n")).where(F.col("n") >= support).select("before", "hits"))
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(0))).alias("r")).select(F.translate("r", _QUIET, "").alias("before"))
    totals = runs.join(_small(contexts.select("before")), "before", "left_semi").groupBy("before").agg(F.count("*").alias("total"))
    return cut(contexts.join(totals, "before").where(F.col("hits") >= rate * F.col("total")).select("before"))


def learn(found: DataFrame, docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT, rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """(occurrences, patterns): the candidates (key, start, end, core, state, pattern) in specific contexts, and the patterns (pattern, score) that discover."""
    rows = found.select("key", F.explode("candidates").alias("c")).select("key", "c.*").where("before <> ''")
    named = _salted(rows, specific_contexts(rows, docs, support, rate), "before")
    patterns = F.array(_pattern(F.col("before"), _shape(F.col("core"))), _pattern(F.col("before"), F.lit("*")))
    occurrences = cut(named.select("key", "start", "end", "core", "state", F.explode(patterns).alias("pattern")))
    # an instance is a seed if it is one anywhere, else refused if it is that anywhere
    edges = cut(occurrences.groupBy("pattern", "core").agg(F.max((F.col("state") == 1).cast("int")).alias("seed"), F.max((F.col("state") == -1).cast("int")).alias("refused")))
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"))
    able = cut(size.where(F.col("seeds") >= support).select("pattern", "n"))
    # only patterns with enough seeds or accepted instances can discover, so only their edges go on
    graph = cut(_salted(edges, able).select("pattern", "core", "seed", "refused", "n"))
    scores = graph.groupBy("pattern").agg((F.sum("seed") / F.first("n")).alias("score"))
    left = rounds
    while left > 0:
        left -= 1
        voted = _salted(graph, scores)
        instances = voted.groupBy("core").agg(F.max("seed").alias("seed"), F.max("refused").alias("refused"), (1 - F.exp(F.sum(F.log1p(-F.least(F.col("score") * DAMPING, F.lit(0.999)))))).alias("s"))
        rated = cut(instances.select("core", (F.col("seed") == 1).alias("known"), F.when(F.col("seed") == 1, F.lit(1.0)).when(F.col("refused") == 1, F.lit(0.0)).otherwise(F.col("s") * DAMPING).alias("s")))
        accepted = rated.where(~F.col("known") & (F.col("s") >= confidence)).select("core")
        if not accepted.isEmpty():
            more = edges.join(accepted, "core").groupBy("pattern").agg(F.count("*").alias("more"))
            fresh = cut(size.join(more, "pattern").where(F.col("seeds") + F.col("more") >= support).select("pattern", "n").join(able, "pattern", "left_anti"))
            if not fresh.isEmpty():
                able = cut(able.union(fresh))
                graph = cut(graph.union(_salted(edges, fresh).select("pattern", "core", "seed", "refused", "n")))
                left = rounds  # patterns never leave, so this ends
        scores = cut(graph.join(rated, "core", "left").groupBy("pattern").agg((F.sum(F.coalesce("s", "seed")) / F.first("n")).alias("score")))
    return occurrences, scores.where(F.col("score") >= confidence).select("pattern", "score")


def _salted(large: DataFrame, small: DataFrame, on: str = "pattern") -> DataFrame:
    """An inner join on a key whose hot values' rows go to SALT places; `small` has one row for each key."""
    a = large.withColumn("_s", F.pmod(F.xxhash64("core"), F.lit(SALT)))
    b = small.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return a.join(b, [on, "_s"]).drop("_s")


def discovered(found: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """(key, id): the spans that patterns find, for each key that has some."""
    occurrences, patterns = learn(found, docs, **options)
    # a refused instance stays out wherever it stands
    refused = occurrences.where("state = -1").select("core").distinct()
    free = occurrences.where("state = 0").join(refused, "core", "left_anti")
    return cut(_salted(free, patterns).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("id")))


def all_spans(docs: DataFrame, **options) -> DataFrame:
    """(key, doc_id, email, ip, card, phone, secret, id): the spans of every row."""
    found = cut(base_spans(docs))
    fresh = discovered(found, docs, **options)
    open_ones = F.exists("candidates", lambda c: (c["state"] == 0) & (c["before"] != ""))
    empty = F.array().cast(_PAIRS)
    with_some = found.where(open_ones).drop("candidates").join(_small(fresh), "key", "left").withColumn("id", F.coalesce("id", empty))
    return with_some.unionByName(found.where(~open_ones).drop("candidates").withColumn("id", empty))


def _tagged(kinds: tuple[str, ...]) -> Column:
    """All spans of the kinds as (start, rank, end, kind), in order."""

    def named(n: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))

    parts = [F.transform(k, named(n, k)) for n, k in enumerate(kinds)]
    return F.array_sort(F.flatten(F.array(*parts)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_spans, base_sha256, spans) of every row."""
    every = _tagged((*FOUND, "id"))
    return all_spans(docs, **options).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.size(every).cast("long").alias("n_spans"),
        F.sha2(_joined(_tagged(KINDS)), 256).alias("base_sha256"), _joined(every).alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """(start, end, kind) of the spans (in order), those that overlap put together."""

    def with_ends(s: Column) -> Column:
        def with_starts(reach: Column) -> Column:
            first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["start"] >= F.get(reach, i - 1)))
            return _let(first, lambda at: F.transform(at, lambda i, j: F.struct(
                F.get(s, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(at, j + 1), F.size(s)) - 1).alias("end"), F.get(s, i)["kind"].alias("kind"))))

        return _let(_scan(F.transform(s, lambda x: x["end"]), lambda x, y: F.greatest(x, y)), with_starts)

    return _let(spans, with_ends)


def _between(blocks: Column, a: Column, b: Column) -> Column:
    """The code points a to b of a text that is cut into blocks; looks at the blocks around them only."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    inside = F.substring(F.get(blocks, i), a % BLOCK + 1, b - a)
    across = F.concat(F.substring(F.get(blocks, i), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.coalesce(F.get(blocks, j), F.lit("")), F.lit(1), b % BLOCK))
    return F.when(b <= a, F.lit("")).when(i == j, inside).otherwise(across)


def _redacted(text: Column, spans: Column) -> Column:
    """The text with its spans replaced, put together from the pieces between them in time linear in both."""

    def put(m: Column) -> Column:
        def pieces(blocks: Column) -> Column:
            start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(m, i - 1)["end"])
            parts = F.transform(m, lambda s, i: F.concat(_between(blocks, start(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            return F.concat(F.array_join(parts, ""), _between(blocks, F.get(m, F.size(m) - 1)["end"], F.length(text)))

        return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), pieces)

    return F.when(F.size(spans) > 0, _let(_merged(spans), put)).otherwise(text)


def redact(docs: DataFrame, **options) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars, where it is there, is counted anew.

    Each row finds its own spans once more, so its text stays where it is; only what patterns
    discovered comes from elsewhere, broadcast if it is little (SMALL rows), else by key.
    """
    fresh = discovered(cut(base_spans(docs)), docs, **options).withColumnRenamed("key", "_key")
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce("text", F.lit("")).alias("text"), _key().alias("_key"))
    spans = _spans(rows, candidates=False).join(_small(fresh), "_key", "left").withColumn("id", F.coalesce("id", F.array().cast(_PAIRS)))
    done = spans.select("_row", "text", _tagged((*FOUND, "id")).alias("_spans")).select("_row", F.when(F.col("_row.text").isNotNull(), _redacted(F.col("text"), F.col("_spans"))).alias("_new"))
    return done.select(*(F.col("_new").alias(c) if c == "text" else F.length("_new").cast("long").alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns))
