"""Secret scan with multipart credential linking; DataFrame functions only.

Strong findings (``assign``, ``access``, ``hex``) are reported wherever they are.  Weak candidates are reported only
where complementary parts lie within ``scope`` code points of each other in a document:

* ``login``: a user or client name, beside a strong secret, or beside a weak one and an endpoint;
* ``key``: a mixed run of letters and digits, beside an access identifier, or beside a login and an endpoint;
* ``endpoint``: an address (a url, or a host of its own outside of urls), beside an identifier and a secret of any strength.

Parts meet in an interval join: parts are pre-aggregated by document and interval to their first and last place,
and each candidate meets its own interval and the two beside it, so it meets three rows at most for each role.
The join's key is the text's digest, so copies of a text are linked once.

Defined results: a null text is empty; rows come out as often as they came, equal texts with equal spans; places
are in code points, ends exclusive; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, text_of

#: Fixed patterns; kinds in the order of reports.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LOGIN = r"""(?i:user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}"""
KEY = r"[A-Za-z0-9+/]{20,}"
URL = r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+"""
#: A run is tried once, from its start; no group is repeated, so Java's matcher doesn't recurse.
HOST = r"(?<![a-z0-9.-])[a-z0-9.-]+\.amazonaws\.com"
KINDS = ["assign", "access", "hex", "login", "key", "endpoint"]
BLOCK = 512


def matches(text: Column, pattern: str) -> Column:
    """Places of all leftmost matches that don't overlap: an array of (start, end, size of group 2 or 0 ...).

    The text between matches and the matches themselves give lengths; their running sums are made in blocks,
    so a text with very many matches takes time in proportion."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    return F.arrays_zip(F.slice(gaps, F.lit(1), F.size(sizes)).alias("gap"), sizes.alias("size"))


SPAN = "array<struct<start:int,end:int>>"


def summed(steps: str) -> str:
    """SQL for the places of an array of (gap, size)."""
    total = f"transform(sequence(0, greatest(0, size({steps}) - 1) div {BLOCK}), b -> aggregate(slice({steps}, b * {BLOCK} + 1, {BLOCK}), 0, (a, s) -> a + s.gap + s.size))"
    before = f"aggregate({total}, cast(array(0) as array<int>), (a, t) -> array_append(a, element_at(a, -1) + t))"
    inside = (f"(x, b) -> aggregate(slice({steps}, b * {BLOCK} + 1, {BLOCK}), named_struct('at', x, 'out', cast(array() as {SPAN})), "
              "(a, s) -> named_struct('at', a.at + s.gap + s.size, 'out', array_append(a.out, named_struct('start', a.at + s.gap, 'end', a.at + s.gap + s.size))), a -> a.out)")
    return f"flatten(transform({before}, {inside}))"


def outside(hosts: str, urls: str) -> str:
    """SQL for the urls and those hosts that lie in none: both are in order, so each host needs the last url that starts
    before it, found among all starts at once."""
    starts = f"array_sort(concat(transform({urls}, x -> named_struct('start', x.start, 'host', 0, 'end', x.end)), transform({hosts}, x -> named_struct('start', x.start, 'host', 1, 'end', x.end))))"
    inside = (f"(x, b) -> aggregate(slice(s, b * {BLOCK} + 1, {BLOCK}), named_struct('at', x, 'out', cast(array() as {SPAN})), (a, y) -> named_struct("
              "'at', if(y.host = 0, greatest(a.at, y.end), a.at), 'out', if(y.host = 0 or y.start >= a.at, array_append(a.out, named_struct('start', y.start, 'end', y.end)), a.out)), a -> a.out)")
    blocks = f"transform(sequence(0, greatest(0, size(s) - 1) div {BLOCK}), b -> aggregate(slice(s, b * {BLOCK} + 1, {BLOCK}), 0, (a, y) -> if(y.host = 0, greatest(a, y.end), a)))"
    before = f"aggregate({blocks}, cast(array(0) as array<int>), (a, t) -> array_append(a, greatest(element_at(a, -1), t)))"
    found = f"transform(array({starts}), s -> flatten(transform({before}, {inside})))[0]"
    return f"if(size({hosts}) = 0, {urls}, {found})"


#: Of each kind: its pattern, a cheap test that a text may have it, and the least size of a match.
FIND = {
    "assign": (ASSIGN, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 0),
    "access": (ACCESS, r"AKIA[A-Z0-9]{12}", 16),
    "hex": (r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 32),
    "login": (LOGIN, r"""(?i:user(?:name)?|login|client_?id|account_?id)["']?\x20*[:=]""", 0),
    "key": (KEY, KEY, 20),
    "url": (URL, r"[a-z0-9+.-]://", 0),
    "host": (HOST, r"\.amazonaws\.com", 0),
}


def scan(docs: DataFrame, text: str = "text", carry: tuple = ("doc_id",), scope: int = 256) -> DataFrame:
    """The ``carry`` columns, ``base`` and ``spans``: arrays of (start, kind, end), in the order of start, then kind
    (its number in ``KINDS``).  ``spans`` are the base spans and the linked weak ones."""
    rows = docs.select(text_of(docs, text).alias("text"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    kept = [f"c{i}" for i in range(len(carry))]
    # weak candidates matter only in texts that have complementary parts at all
    may = {k: F.col("text").rlike(test) for k, (_, test, _) in FIND.items()}
    rows = rows.select(*kept, "text", *[may[k].alias(f"may_{k}") for k in FIND])
    secret, identity = "(may_assign or may_hex or may_key)", "(may_access or may_login)"
    needed = {"assign": "may_assign", "access": "may_access", "hex": "may_hex", "login": f"may_login and {secret}", "key": f"may_key and {identity}", "url": f"may_url and {secret} and {identity}", "host": f"may_host and {secret} and {identity}"}
    none = "cast(array() as array<struct<gap:int,size:int>>)"
    steps = [F.when(F.expr(needed[k]), matches(F.col("text"), FIND[k][0])).otherwise(F.expr(none)).alias(f"steps_{k}") for k in FIND]
    values = F.when(F.col("may_assign"), F.transform(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.char_length)).otherwise(F.expr("cast(array() as array<int>)"))
    keys = F.when(F.expr(needed["key"]), F.transform(F.regexp_extract_all("text", F.lit(KEY), F.lit(0)), mixed)).otherwise(F.expr("cast(array() as array<boolean>)"))
    rows = rows.select(*kept, F.sha2("text", 256).alias("digest"), *steps, values.alias("values"), keys.alias("mixed"))
    rows = rows.select(*kept, "digest", "values", "mixed", *[F.expr(f"if(size(steps_{k}) = 0, cast(array() as {SPAN}), {summed(f'steps_{k}')})").alias(k) for k in FIND])
    rows = rows.withColumn("endpoint", F.expr(outside("host", "url")))
    keep = {"assign": "filter(assign, (x, i) -> values[i] >= 8)", "key": "filter(key, (x, i) -> mixed[i])"}
    part = {k: f"transform({keep.get(k) or f'filter({k}, x -> x.end - x.start >= {FIND[k][2] if k in FIND else 0})'}, x -> named_struct('start', x.start, 'kind', {i}, 'end', x.end))" for i, k in enumerate(KINDS)}
    rows = rows.select(*kept, "digest", F.expr(f"array_sort(concat({', '.join(part[k] for k in KINDS[:3])}))").alias("base"), F.expr(f"concat({', '.join(part[k] for k in KINDS[3:])})").alias("weak"))
    rows = materialise(rows, "secret-parts")
    links = materialise(linked(rows.where("size(weak) > 0"), scope), "secret-links")
    out = rows.join(links, "digest", "left")
    spans = F.expr("if(linked is null, base, array_sort(concat(base, linked)))")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "base", spans.alias("spans"))


def mixed(run: Column) -> Column:
    """Whether a run of letters and digits looks like a key: it has upper and lower case and digits."""
    return run.rlike("[A-Z]") & run.rlike("[a-z]") & run.rlike("[0-9]")


def linked(rows: DataFrame, scope: int) -> DataFrame:
    """``digest, linked``: the weak spans whose complementary parts lie within the scope."""
    role = {"identity": (1,), "login": (3,), "secret": (0, 2), "key": (4,), "endpoint": (5,)}
    parts = rows.select("digest", F.explode(F.concat("base", "weak")).alias("p")).select("digest", "p.start", "p.kind", "p.end", F.floor(F.col("p.start") / scope).alias("interval"))
    ends = [f(F.when(F.col("kind").isin(*kinds), F.col("start"))).alias(f"{n}_{r}") for r, kinds in role.items() for n, f in (("first", F.min), ("last", F.max))]
    held = parts.groupBy("digest", "interval").agg(*ends)
    weak = parts.where("kind >= 3").distinct().withColumn("step", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)])))
    met = weak.withColumn("interval", F.col("interval") + F.col("step")).join(held, ["digest", "interval"])
    near = [F.max((F.col(f"last_{r}") >= F.col("start") - scope) & (F.col(f"first_{r}") <= F.col("start") + scope)).alias(r) for r in role]
    found = met.groupBy("digest", "start", "kind", "end").agg(*near)
    found = found.na.fill(False, list(role))
    rule = ("case kind when 3 then secret or (key and endpoint) when 4 then identity or (login and endpoint) "
            "else (identity or login) and (secret or key) end")
    return found.where(rule).groupBy("digest").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def written(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "<secret>", scope: int = 256) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark`` (touching spans by one); other texts
    and all other columns stay as they are, null texts too."""
    spans, at = free_name(docs, "spans"), list(docs.columns)
    found = scan(docs, "text", tuple(at), scope).toDF(*[f"c{i}" for i in range(len(at))], "base", spans)
    text = f"c{at.index('text')}"
    # in blocks of spans: each has the text from the end of all spans before it to the end of its own
    ends = f"transform(sequence(0, greatest(0, size({spans}) - 1) div {BLOCK}), b -> aggregate(slice({spans}, b * {BLOCK} + 1, {BLOCK}), 0, (a, x) -> greatest(a, x.end)))"
    found = found.withColumn("ends", F.expr(f"aggregate({ends}, cast(array(0) as array<int>), (a, t) -> array_append(a, greatest(element_at(a, -1), t)))"))
    parts = f"transform(ends, (e, b) -> substring({text}, e + 1, if(b + 1 < size(ends), ends[b + 1] - e, 0)))"
    found = found.withColumn("parts", F.expr(parts))
    blank = (f"aggregate(slice({spans}, b * {BLOCK} + 1, {BLOCK}), named_struct('at', ends[b], 'out', cast(array() as array<string>)), (a, x) -> named_struct('at', greatest(a.at, x.end), 'out', "
             f"if(x.start > a.at or a.at = 0, array_append(a.out, concat(substring(part, a.at - ends[b] + 1, x.start - a.at), '{mark}')), a.out)), a -> array_join(a.out, ''))")
    clean = F.expr(f"if(size({spans}) = 0, {text}, concat(array_join(transform(parts, (part, b) -> {blank}), ''), substring({text}, element_at(ends, -1) + 1)))")
    return found.withColumn(text, clean).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(at)])
