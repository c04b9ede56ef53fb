"""Secret scans: multipart credential linking with DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import read, spare_name
from weft.session import materialize

#: Kinds in the order in which spans with one start are listed. The first three are the base kinds.
KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]


@dataclass(frozen=True)
class Part:
    """One kind of span. A match counts if its `group` has `least` characters; `side` says what it can complete."""

    kind: str
    pattern: str
    group: int
    least: int
    side: str


BASE = [
    Part("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret"),
    Part("access", r"AKIA[A-Z0-9]+", 0, 20, "access"),
    Part("hex", r"[0-9a-f]+", 0, 24, "secret"),
]
#: What alone proves nothing: account names, opaque strings and addresses of services.
WEAK = [
    Part("ident", r"""(?i)\b(access_?key_?id|client_?id|account_?id|username|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, "access"),
    Part("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}", 0, 20, "secret"),
    Part("endpoint", r"(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|sftp|ssh)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 0, 10, "endpoint"),
]
#: What divides a text into scopes: blank lines.
BREAK = Part("break", r"\n[\x20\t\r]*(?=\n)", 0, 1, "")
#: A cheap test that a text without a match of the kind mostly fails.
HINT = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": "AKIA",
    "hex": r"[0-9a-f]{24}",
    "ident": r"(?i)(?:_?id|username|login)[\"']?\x20*[:=]",
    "opaque": r"[A-Za-z0-9+/_-]{20}",
    "endpoint": "://",
    "break": r"\n[\x20\t\r]*\n",
}
#: Prefix sums run over blocks of so many matches: a text with n matches costs n * BLOCK + n * n / (2 * BLOCK) steps.
BLOCK = 256


def _matched(part: Part, text: Column) -> Column:
    """(match, value) of every match of the base pattern, short ones included."""
    every = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(part.group)) if part.group else every
    hint = HINT[part.kind]
    plain = hint.isalnum() or hint == "://"
    likely = text.contains(hint) if plain else text.rlike(hint)
    pairs = F.arrays_zip(every, value).cast("array<struct<m:string,v:string>>")
    return F.when(likely, pairs).otherwise(F.array().cast("array<struct<m:string,v:string>>"))


def _spans(kind: str, least: int) -> Column:
    """Starts and ends, as code points, of the matches in column m_<kind> that are long enough; gaps are in g_<kind>."""
    m, g = f"m_{kind}", f"g_{kind}"
    order = KINDS.index(kind) if kind in KINDS else len(KINDS)
    return F.expr(f"""
        case when size({m}) = 0 then cast(array() as array<struct<s:int,o:int,e:int>>) else
        transform(filter(
          flatten(transform(
            transform(sequence(0, (size({m}) - 1) div {BLOCK}), b -> struct(
              b as b,
              transform(slice({m}, int(b * {BLOCK} + 1), {BLOCK}), (x, i) -> struct(
                length({g}[int(b * {BLOCK} + i)]) as gap, length(x.m) as n, length(x.v) >= {least} as ok)) as items)),
            k -> aggregate(
              k.items,
              struct(
                {f"aggregate(slice({m}, 1, int(k.b * {BLOCK})), 0, (a, x) -> a + length(x.m)) + aggregate(slice({g}, 1, int(k.b * {BLOCK})), 0, (a, x) -> a + length(x))"} as at,
                cast(array() as array<struct<s:int,o:int,e:int,ok:boolean>>) as out),
              (a, x) -> struct(
                a.at + x.gap + x.n as at,
                concat(a.out, array(struct(a.at + x.gap as s, {order} as o, a.at + x.gap + x.n as e, x.ok as ok))) as out),
              a -> a.out))),
          x -> x.ok), x -> struct(x.s as s, x.o as o, x.e as e)) end
    """)


def _with_spans(docs: DataFrame, parts: list[Part], text: str) -> DataFrame:
    """Adds s_<kind>, an array of (s, o, e[, ok]), for each part."""
    out = docs
    for p in parts:
        out = out.withColumn(f"m_{p.kind}", _matched(p, F.col(text)))
    for p in parts:
        out = out.withColumn(f"g_{p.kind}", F.when(F.size(f"m_{p.kind}") > 0, F.split(F.col(text), p.pattern)))
    for p in parts:
        out = out.withColumn(f"s_{p.kind}", _spans(p.kind, p.least))
    return out


def scan_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, base, weak, breaks): every row's base spans and weak candidates, and where its scopes end if it has weak
    candidates, each an array of (s, o, e) by start.

    `h` is a hash of the text; (id, h) stands for the row, as rows that agree in both have the same spans.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    found = _with_spans(rows, BASE + WEAK, "t")

    def gathered(parts: list[Part]) -> Column:
        names = ", ".join(f"s_{p.kind}" for p in parts)
        return F.expr(f"array_sort(transform(concat({names}), x -> struct(x.s as s, x.o as o, x.e as e)))")

    # texts without candidates need no scopes
    found = found.select("id", "h", "t", gathered(BASE).alias("base"), gathered(WEAK).alias("weak"))
    found = found.withColumn("t", F.when(F.size("weak") > 0, F.col("t")).otherwise(F.lit("")))
    return _with_spans(found, [BREAK], "t").select("id", "h", "base", "weak", F.col("s_break").alias("breaks"))


def link_parts(parts: DataFrame, reach: int) -> DataFrame:
    """(id, h, linked): the weak candidates near enough to what completes them, in the same scope.

    Scopes are the stretches of a text between blank lines. The interval join is a sweep: with a scope's parts in order
    of start, a part lies within `reach` of one on its left if the greatest end so far says so, and of one on its right if
    the least start still to come does. That takes two sorts per text and emits a row per part, never a pair of parts.
    """
    side = {i: p.side for p in BASE + WEAK for i, k in enumerate(KINDS) if k == p.kind}
    rows = (
        parts.where("size(weak) > 0 and size(weak) + size(base) > 1")
        .dropDuplicates(["id", "h"])
        .select("id", "h", F.explode(F.concat("base", "weak", "breaks")).alias("x"))
        .select("id", "h", "x.s", "x.o", "x.e")
    )
    sofar = Window.partitionBy("id", "h").orderBy("s", F.desc("o"), "e").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum((F.col("o") == len(KINDS)).cast("int")).over(sofar)).where(F.col("o") < len(KINDS))
    left = Window.partitionBy("id", "h", "scope").orderBy("s", "o", "e").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("id", "h", "scope").orderBy(F.desc("s"), F.desc("o"), F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)

    def near(test: Column, by: int) -> Column:
        before = F.max(F.when(test, F.col("e"))).over(left) >= F.col("s") - by
        after = F.min(F.when(test, F.col("s"))).over(right) <= F.col("e") + by
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    of = {name: F.col("o").isin([i for i, s in side.items() if s == name]) for name in ("access", "secret")}
    rows = rows.select(
        "id", "h", "s", "o", "e",
        near(of["access"], reach).alias("by_access"),
        near(of["secret"], reach).alias("by_secret"),
        near(F.col("o") < len(BASE), -1).alias("inside"),
    )
    ident, opaque, endpoint = (KINDS.index(k) for k in ("ident", "opaque", "endpoint"))
    good = (
        ((F.col("o") == ident) & F.col("by_secret"))
        | ((F.col("o") == opaque) & F.col("by_access"))
        | ((F.col("o") == endpoint) & F.col("by_access") & F.col("by_secret"))
    )
    return rows.where(good & ~F.col("inside")).groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("s", "o", "e"))).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(id, base, linked): each row's base spans and the weak candidates that complementary parts confirm.

    Spans are (s, o, e): start, place of the kind in KINDS, end (exclusive), in code points. An account name counts
    within `reach` code points of a secret, an opaque string within reach of an access identifier or account name, an
    address within reach of both, all without a blank line between; a candidate inside a base span never counts. A null text is empty and has no spans;
    each input row gives one output row, also where ids are null or repeated; other columns aren't read.
    """
    parts = materialize(scan_parts(docs, id_col, text_col))
    linked = link_parts(parts, reach).select(F.col("id").alias("i"), F.col("h").alias("g"), "linked")
    none = F.array().cast("array<struct<s:int,o:int,e:int>>")
    joined = parts.select("id", "h", "base").join(linked, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    return joined.select("id", "h", "base", F.coalesce("linked", none).alias("linked"))


def span_text(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', array({names})[x.o], cast(x.s as string), cast(x.e as string))), ',')")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of find_secrets replaced by `mark` (overlapping ones by one); all columns and rows stay.

    Null texts stay null. Only rows with spans meet the texts again, and a text is read once for its spans and once to
    be put together anew.
    """
    # written before it is filtered: a filter on the spans would move below them and find them several times over
    parts = materialize(scan_parts(docs, id_col, text_col)).where("size(base) + size(weak) > 0")
    linked = link_parts(parts, reach).select(F.col("id").alias("i"), F.col("h").alias("g"), "linked")
    spans = parts.dropDuplicates(["id", "h"]).join(linked, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")
    none = F.array().cast("array<struct<s:int,o:int,e:int>>")
    # names that no column of docs has
    i, g, found, h = (spare_name(docs.columns, x) for x in ("i", "g", "spans", "h"))
    spans = spans.select(F.col("id").alias(i), F.col("h").alias(g), F.array_sort(F.concat("base", F.coalesce("linked", none))).alias(found))
    spans = materialize(spans.where(F.size(found) > 0))
    hashed = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    out = hashed.join(spans, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(h) == F.col(g)), "left")
    quoted = mark.replace("'", "''")
    masked = F.expr(f"""
        case when {found} is null then `{text_col}` else
          array_join(transform(
            aggregate({found}, struct(0 as at, cast(array() as array<struct<s:int,e:int>>) as out),
              (a, x) -> struct(greatest(a.at, x.e) as at,
                case when x.s < a.at then a.out else concat(a.out, array(struct(a.at as s, x.s as e))) end as out),
              a -> concat(a.out, array(struct(a.at as s, length(`{text_col}`) as e)))),
            x -> substring(`{text_col}`, x.s + 1, x.e - x.s)), '{quoted}') end""")
    return out.select(*[masked.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base spans by kind, their digest, and all spans with the linked candidates. Null texts are empty."""
    found = find_secrets(read(spark, sf_dir, "documents"))
    count = {k: F.expr(f"cast(size(filter(base, x -> x.o = {KINDS.index(k)})) as bigint)").alias(f"n_{k}") for k in KINDS[:3]}
    return found.select(
        F.col("id").alias("doc_id"),
        *count.values(),
        F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("array_sort(concat(base, linked))").alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
