"""Chat formatting: quotation linking and reply-ordered conversations without quotes."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import lists, map_batches, read, shingle_hashes
from weft.session import materialize

#: Marks of a quoted line: any number of ">" with spaces between.
LEVEL = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
#: Lines that only introduce a quote.
INTRO = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|(?:am|le|el)\b.{0,200}(?:schrieb|écrit|escribió).{0,80}|[-_]{2,}\s*original message\s*[-_]{2,}|.{1,80}\b(?:wrote|said))\s*:?\s*$", re.I)
#: A passage or line without so many letters and digits proves nothing and isn't linked.
LEAST = 2
#: One of fewer words is linked only where the message begins with a quote, or a line announces the quote.
LEAST_WORDS = 3
#: Words of a shingle, and the share of a quote's words that shingles of earlier messages must cover.
SHINGLE, CONTAINED = 5, 0.8
#: The end of a sentence, with the quotes and brackets that close after it.
SENTENCE = re.compile(r"""(?<=[.!?…])["'”’»)\]]*\s+|(?<=。)""")


def normal(text: str) -> str:
    """Letters and digits in lower case, words apart by one space."""
    return " ".join(re.findall(r"[^\W_]+", text.casefold()))


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def levels(text: str) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of each line."""
    out = []
    for line in text.split("\n"):
        found = LEVEL.match(line)
        if found:
            out.append((found[1].count(">"), line[found.end() :]))
        else:
            out.append((0, line))
    return out


def parse_message(text: str) -> list[tuple[int, str, bool]]:
    """(quote level, text as it stands, is it announced) of the stretches of a message in order.

    A stretch is a run of lines of one level; blank quoted lines divide paragraphs inside it. A line that only introduces a
    quote and the blank lines after it are a stretch of level -1, and the quote after it is announced, as are all levels
    that follow without a line of level 0 between.
    """
    out: list[tuple[int, list[str], bool]] = []
    for raw, (level, _) in zip(text.split("\n"), levels(text)):
        if level and (not out or out[-1][0] != level):
            announced = False
            if out and out[-1][0] == 0:
                own = out[-1][1]
                end = len(own)
                while end and not own[end - 1].strip():
                    end -= 1
                if end and INTRO.match(own[end - 1]):
                    out.append((-1, own[end - 1 :], True))
                    del own[end - 1 :]
                    announced = True
            elif out:
                announced = out[-1][2]
            out.append((level, [raw], announced))
        elif not level and (not out or out[-1][0] != 0):
            out.append((0, [raw], False))
        else:
            out[-1][1].append(raw)
    return [(level, "\n".join(x), announced) for level, x, announced in out if x]


def quoted(text: str) -> str:
    """A stretch of quoted lines without their marks."""
    return "\n".join(line for _, line in levels(text)).strip()


def without_quotes(parts: list[tuple[int, str, bool]], linked: set[int]) -> tuple[str, int]:
    """(the message without its quotes, number of quotes): the stretches that are linked or announced go, and with them what
    introduces them."""
    own, n = [], 0
    for i, (level, text, announced) in enumerate(parts):
        if level > 0 and (i in linked or announced):
            n += 1
        elif level >= 0:
            own.append(text)
    return "\n".join(own).strip(), n


def passages(text: str) -> set[str]:
    """The normalised texts by which a text can be found: the whole, each paragraph, line and sentence, if long enough."""
    paragraphs = re.split(r"\n\s*\n", text)
    parts = [text, *paragraphs, *text.split("\n"), *(x for p in paragraphs for x in SENTENCE.split(p))]
    return {x for x in map(normal, parts) if len(x) >= LEAST}


def marks(text: str) -> set[int]:
    """Digests of the passages."""
    return set(map(digest, passages(text)))


def quote_marks(parts: list[tuple[int, str, bool]]) -> list[tuple[int, int, int]]:
    """(digest, level, place of the stretch) of what a parsed message quotes; see LEAST_WORDS."""
    begins = next((level != 0 for level, text, _ in parts if text.strip()), False)
    out = set()
    for place, (level, text, announced) in enumerate(parts):
        if level > 0:
            out |= {(digest(x), level, place) for x in passages(quoted(text)) if begins or announced or x.count(" ") + 1 >= LEAST_WORDS}
    return sorted(out)


def _contained(placed: DataFrame, found: DataFrame) -> DataFrame | None:
    """(conv, turn, h, level, p, source) of the stretches of quotes without a digest of their own in `found`, but with at
    least CONTAINED of their words in shingles that earlier messages have; None if all stretches are linked.

    Each shingle counts for the latest message before that has it, and the stretch for the message with most of them.
    """
    kind = {c: placed.schema[c].dataType.simpleString() for c in ("conv", "turn")}
    stretches = placed.select("conv", "turn", "h", F.posexplode("parts").alias("p", "x")).where("x.level > 0")
    stretches = stretches.select("conv", "turn", "h", "p", "x.level", "x.t").dropDuplicates(["conv", "turn", "h", "p"])
    stretches = materialize(stretches.join(found.select("conv", "turn", "h", "p").distinct(), ["conv", "turn", "h", "p"], "left_anti"))
    if not stretches.limit(1).count():
        return None

    def shingled(batches):
        for batch in batches:
            n = batch.num_columns - 1
            plain = [normal(quoted(t) if n > 2 else t).encode("utf-8", "surrogatepass") for t in batch.column(n).to_pylist()]
            h, counts = shingle_hashes(plain, SHINGLE)
            n_words = pa.array([t.count(b" ") + 1 for t in plain], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n_words, lists(h.view("int64"), counts, pa.int64())], names=[*batch.schema.names[:-1], "n_words", "s"])

    shapes = "n_words int, s array<bigint>"
    asked = map_batches(stretches, shingled, f"conv {kind['conv']}, turn {kind['turn']}, h bigint, p int, level int, {shapes}")
    asked = materialize(asked.where(F.col("n_words") >= SHINGLE).select("conv", "turn", "h", "p", "level", "n_words", F.posexplode("s").alias("at", "s")))
    # of the originals only conversations with such stretches, and of them only shingles that one of these has
    own = placed.join(stretches.select("conv").distinct(), "conv", "left_semi")
    own = own.select("conv", "turn", F.expr("array_join(transform(filter(parts, x -> x.level = 0), x -> x.t), '\\n')").alias("t"))
    original = map_batches(own, shingled, f"conv {kind['conv']}, turn {kind['turn']}, {shapes}").where(F.col("n_words") >= SHINGLE).select("conv", "turn", F.explode("s").alias("s"))
    original = original.join(asked.select("conv", "s").distinct(), ["conv", "s"], "left_semi").distinct()
    names = ("h", "p", "level", "n_words", "at")
    both = original.select("conv", "s", "turn", *(F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in names)).union(asked.select("conv", "s", "turn", *names))
    before = Window.partitionBy("conv", "s").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    hit = both.withColumn("source", F.max(F.when(F.col("p").isNull(), F.col("turn"))).over(before)).where("p is not null and source is not null")
    stretch = ["conv", "turn", "h", "level", "p"]
    by_source = hit.groupBy(*stretch, "n_words", "source").agg(F.count(F.lit(1)).alias("n"), F.collect_list("at").alias("at"))
    whole = by_source.groupBy(*stretch, "n_words").agg(F.max(F.struct("n", "source"))["source"].alias("source"), F.flatten(F.collect_list("at")).alias("at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + (SHINGLE - 1))))))
    return whole.where(covered >= CONTAINED * F.col("n_words")).select(*stretch, "source")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, n_quotes, parent, root) for every message, texts without their quotes.

    A passage behind quote marks is a quote if it is linked to an earlier message or a line before it announces it ("On
    .. wrote:"); only these go, so code and other lines that begin with the mark stay. It is linked by its whole, a
    paragraph, a line or a sentence (such of one or two words only in a message that begins with a quote, or if announced),
    or else if shingles of five words that earlier messages of the conversation have cover 0.8 of its words. parent: the turn of the
    conversation that the message's quotes of level 1 come from (the one with most of their passages, of equals
    the latest; a quote linked by shingles counts once), null if they come from none or there are none; deeper quotes count if no level 1 quote
    is found. Only earlier turns can be parents. root: where the chain of parents ends. In order of (conv, root, turn) a
    conversation reads thread by thread, and each reply after what it answers.

    Passages are compared by digests of their normalised text: letters and digits in lower case. Equal originals of a
    conversation meet in one sweep for each digest, which links a quote to the latest of them before it, so that no
    pairs of messages are made, and one long conversation is spread over its digests. A null text is empty; rows with a
    null conversation or turn link with nothing; rows that repeat conversation and turn are kept, and count as one
    message where they are quoted.
    """
    conv = messages.schema[conv_col].dataType.simpleString()
    turn = messages.schema[turn_col].dataType.simpleString()
    rows = messages.select(
        F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"),
    )
    # (conv, turn, h) stands for a message, as rows that agree in all three have the same quotes
    rows = rows.withColumn("h", F.xxhash64("t"))

    def run(batches):
        for batch in batches:
            parts, originals, quotes = [], [], []
            for text in batch.column(3).to_pylist():
                found = parse_message(text)
                parts.append([{"level": level, "t": t, "a": a} for level, t, a in found])
                originals.append(sorted(marks("\n".join(t for level, t, _ in found if level == 0).strip())))
                quotes.append([{"m": m, "level": level, "p": p} for m, level, p in quote_marks(found)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(4), pa.array(parts, parts_type), pa.array(originals, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pa.struct([("m", pa.int64()), ("level", pa.int32()), ("p", pa.int32())])))],
                names=["conv", "turn", "role", "h", "parts", "marks", "quotes"],
            )

    parts_type = pa.list_(pa.struct([("level", pa.int32()), ("t", pa.string()), ("a", pa.bool_())]))
    parsed = materialize(map_batches(rows, run, f"conv {conv}, turn {turn}, role string, h bigint, parts array<struct<level:int,t:string,a:boolean>>, marks array<bigint>, quotes array<struct<m:bigint,level:int,p:int>>"))
    placed = parsed.where("conv is not null and turn is not null")
    asked = placed.where("size(quotes) > 0").select("conv", "turn", "h", F.explode("quotes").alias("q")).select("conv", "turn", "h", "q.m", "q.level", "q.p").distinct()
    # only digests that some message of the conversation quotes are of interest
    wanted = asked.select("conv", "m").distinct()
    original = placed.select("conv", "turn", F.explode("marks").alias("m")).join(wanted, ["conv", "m"], "left_semi").distinct()
    none = F.lit(None)
    both = original.select("conv", "m", "turn", none.cast("bigint").alias("h"), none.cast("int").alias("level"), none.cast("int").alias("p")).union(asked.select("conv", "m", "turn", "h", "level", "p"))
    before = Window.partitionBy("conv", "m").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("source", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(before)).where("level is not null and source is not null")
    found = materialize(found.select("conv", "turn", "h", "level", "p", "source"))
    contained = _contained(placed, found)
    if contained is not None:
        found = materialize(found.union(contained))
    votes = found.groupBy("conv", "turn", "level", "source").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("level"), "n", "source"))["source"].alias("parent"))
    links = materialize(best)

    # the root of each reply: chains of parents are halved in each round
    roots = links.select("conv", "turn", F.col("parent").alias("root"))
    for _ in range(64):
        up = roots.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        after = materialize(roots.join(up, ["conv", "root"], "left").select("conv", "turn", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        roots = after.select("conv", "turn", "root")
        if not moved:
            break
    known = links.join(roots, ["conv", "turn"])
    linked = found.groupBy("conv", "turn", "h").agg(F.collect_set("p").alias("linked"))
    out = parsed.select("conv", "turn", "role", "h", "parts").join(linked, ["conv", "turn", "h"], "left").join(known, ["conv", "turn"], "left")
    out = out.select("conv", "turn", "role", "parent", F.coalesce("root", "turn").alias("root"), "parts", "linked")

    def assemble(batches):
        for batch in batches:
            texts, n = [], []
            for parts, places in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist()):
                text, k = without_quotes([(x["level"], x["t"], x["a"]) for x in parts], set(places or ()))
                texts.append(text)
                n.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string()), pa.array(n, pa.int64()), batch.column(3), batch.column(4)], names=["conv", "turn", "role", "text", "n_quotes", "parent", "root"])

    return map_batches(out, assemble, f"conv {conv}, turn {turn}, role string, text string, n_quotes bigint, parent {turn}, root {turn}")


def reply_ordered(messages: DataFrame, **columns: str) -> DataFrame:
    """link_quotes in order of conversation, thread and turn over all partitions."""
    return link_quotes(messages, **columns).repartitionByRange("conv", "root", "turn").sortWithinPartitions("conv", "root", "turn")


def op2_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per message, thread by thread: its text without quotes, and the turn that it answers. Null texts are empty."""
    found = reply_ordered(read(spark, sf_dir, "conversations"))
    return found.select(F.col("conv").alias("conv_id"), "turn", "role", "text", "n_quotes", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), (F.col("root") < F.col("turn")).alias("is_reply"))
