import random

from tests.llm.helpers import prose
from weft.llm.quotes import link_quotes, marks, normal, op2_quote_links, parse_message, passages, quoted, reply_ordered, without_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def test_levels_and_own_text():
    text = "Thanks!\n\nOn Monday, Ann wrote:\n\n> yes, it is\n>> is it so?\n> > really?\n>\n> fine\nNot at all.\n  > inset\n5 > 3"
    parts = parse_message(text)
    assert [(level, quoted(t), a) for level, t, a in parts if level > 0] == [(1, "yes, it is", True), (2, "is it so?\nreally?", True), (1, "fine", True), (1, "inset", False)]
    assert without_quotes(parts, set()) == ("Thanks!\n\nNot at all.\n  > inset\n5 > 3", 3)
    last = max(i for i, (level, _, _) in enumerate(parts) if level > 0)
    assert without_quotes(parts, {last}) == ("Thanks!\n\nNot at all.\n5 > 3", 4)
    assert parse_message("") == [(0, "", False)] and without_quotes(parse_message(">"), set()) == (">", 0)
    assert marks("?!") == set() and len(marks("One, two: THREE four.\n\nfive six seven eight")) == 3
    assert marks("One, two:  THREE four.") == marks("one two three four")


def test_code_that_looks_quoted_stays(spark):
    text = "Try this:\n>>> print(\"hello world again\")\nhello world again\n> diff line"
    found = links(spark, [(1, 0, "user", "how?"), (1, 1, "assistant", text), (1, 2, "user", "On 5 May Bo wrote:\n> gone\nok"), (1, 3, "user", "> how?\n> else\nfine")])
    assert found[1, 1]["text"] == text and found[1, 1]["parent"] is None and found[1, 1]["n_quotes"] == 0
    assert found[1, 2]["text"] == "ok" and found[1, 2]["n_quotes"] == 1
    # a short line is an original too
    assert found[1, 3]["parent"] == 0 and found[1, 3]["text"] == "fine"


def brute(rows):
    """{place: (parent, text, number of quotes)} by holding every quote against every earlier message of the conversation."""
    parsed = [parse_message(t or "") for *_, t in rows]
    plain = ["\n".join(t for level, t, _ in p if level == 0).strip() for p in parsed]
    own = [passages(t) for t in plain]
    five = lambda t: [tuple(normal(t).split()[i : i + 5]) for i in range(len(normal(t).split()) - 4)]
    shingles = [set(five(t)) for t in plain]
    out = {}
    for i, (conv, turn, _, _) in enumerate(rows):
        votes, linked = {}, set()
        earlier = [j for j in range(len(rows)) if conv is not None and turn is not None and rows[j][0] == conv and rows[j][1] is not None and rows[j][1] < turn]
        begins = bool([x for x in parsed[i] if x[1].strip()]) and [x for x in parsed[i] if x[1].strip()][0][0] != 0
        for p, (level, t, announced) in enumerate(parsed[i]):
            if level <= 0:
                continue
            for m in passages(quoted(t)):
                found = [rows[j][1] for j in earlier if m in own[j]]
                if found and (len(m.split()) > 2 or begins or announced):
                    votes.setdefault((level, max(found)), set()).add((p, m))
                    linked.add(p)
            if p not in linked:
                latest = {k: max((rows[j][1] for j in earlier if s in shingles[j]), default=None) for k, s in enumerate(five(quoted(t)))}
                covered = {k + d for k, source in latest.items() if source is not None for d in range(5)}
                if covered and len(covered) >= 0.8 * len(normal(quoted(t)).split()):
                    sources = [x for x in latest.values() if x is not None]
                    votes.setdefault((level, max(sources, key=lambda x: (sources.count(x), x))), set()).add((p, None))
                    linked.add(p)
        best = max(((-level, len(x), source) for (level, source), x in votes.items()), default=None)
        out[i] = (best and best[2], *without_quotes(parsed[i], linked))
    return out


def talk(rng, convs=12):
    """Conversations whose messages quote lines, single sentences and re-wrapped parts of earlier ones."""
    rows = []
    for conv in range(convs):
        said = []
        for turn in range(rng.randint(1, 14)):
            text = "\n".join(rng.choice([prose(rng, rng.randint(1, 6)), "same line here", "ok", "", f"{prose(rng, 9)}. {prose(rng, 8)}? {prose(rng, 20)}."]) for _ in range(rng.randint(1, 4)))
            for _ in range(rng.choice([0, 0, 1, 2])):
                if said:
                    lines = rng.choice(said).split("\n")
                    some = lines[: rng.randint(1, len(lines))]
                    words = " ".join(x for x in lines if not x.startswith(">")).split()
                    if len(words) > 12 and rng.random() < 0.6:
                        # a part that is wrapped anew, with a few words more
                        k = rng.randrange(len(words) - 9)
                        words = words[k : k + rng.randint(9, 30)]
                        for _ in range(rng.randint(0, 2)):
                            words.insert(rng.randint(0, len(words)), "indeed")
                        some = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
                    mark = rng.choice([">", "> ", ">> ", "> > "])
                    quote = "\n".join((mark if rng.random() < 0.9 else ">") + x for x in some)
                    text = rng.choice([f"{quote}\n{text}", f"{text}\n{quote}", f"{text}\nOn Friday Al wrote:\n{quote}"])
            said.append(text)
            rows.append((conv, turn, "user", text))
    return rows


def test_links_against_all_pairs(spark):
    rows = talk(random.Random(31))
    found = links(spark, rows)
    for i, (parent, text, _) in brute(rows).items():
        r = found[rows[i][0], rows[i][1]]
        assert (r["parent"], r["text"]) == (parent, text), rows[i]
    assert sum(r["parent"] is not None for r in found.values()) > 20


def test_parts_of_a_paragraph_are_quotes(spark):
    rng = random.Random(12)
    a, b, c = prose(rng, 11), prose(rng, 9), prose(rng, 30)
    words = c.split()
    wrapped = [*words[4:15], "really", *words[15:26]]
    rows = [
        (1, 0, "user", f"{a}. {b}.\n\n{c}"), (1, 1, "user", f"I ask:\n> {b}\nwhy?"), (1, 2, "user", "> " + "\n> ".join(" ".join(wrapped[i : i + 6]) for i in range(0, 23, 6)) + "\nno"),
        (1, 3, "user", "ok"), (1, 4, "user", "Try:\n> ok"), (1, 5, "user", "> ok\nthanks"), (1, 6, "user", f"> {' '.join(words[:8])} {prose(rng, 9)}\nhalf of it is new"),
    ]
    found = links(spark, rows)
    assert [(found[1, i]["parent"], found[1, i]["text"]) for i in range(1, 7)] == [(0, "I ask:\nwhy?"), (0, "no"), (None, "ok"), (None, "Try:\n> ok"), (3, "thanks"), (None, rows[6][3])]


def test_query_against_all_pairs(spark, tmp_path):
    rows = talk(random.Random(32), 8) + [(None, 0, "user", "> x y z"), (90, None, None, None), (91, 0, "user", ""), (91, 1, "user", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    expected, known = [], brute(rows)
    parents = {rows[i][:2]: x[0] for i, x in known.items()}
    for i, (parent, text, n) in known.items():
        conv, turn, role, _ = rows[i]
        root = turn
        while parents[conv, root] is not None:
            root = parents[conv, root]
        expected.append((conv, turn, role, text, n, parent, root, None if turn is None else root < turn))
    found = op2_quote_links(spark, str(tmp_path)).select("conv_id", "turn", "role", "text", "n_quotes", "parent_turn", "root_turn", "is_reply").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def links(spark, rows):
    return {(r["conv"], r["turn"]): r for r in link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_quotes_are_linked_to_the_latest_original_before(spark):
    a, b, c = (prose(random.Random(i), 15) for i in range(3))
    quote = lambda t, n=1: "\n".join(">" * n + " " + line for line in t.split("\n"))
    rows = [
        (1, 0, "user", a), (1, 1, "assistant", b), (1, 2, "user", f"{quote(a)}\nto the first"), (1, 3, "user", a.upper() + "!"),
        (1, 4, "user", f"{quote(a)}\nto the third"), (1, 5, "user", f"{quote(b + chr(10) + c)}\nmixed"), (1, 6, "user", f"> to the third\n{quote(a, 2)}\nnested"),
        (1, 7, "user", f"{quote(c)}\nquotes what is nowhere before"), (1, 8, "user", c), (2, 0, "user", f"{quote(a)}\nother conversation"), (2, 1, "user", quote("?!") + "\nno letters"),
        (None, 0, "user", quote(a)), (1, None, "user", quote(a)), (3, 0, None, None), (3, 1, "user", ""), (3, 1, "user", ""),
    ]
    found = links(spark, rows)
    parent = {k: r["parent"] for k, r in found.items()}
    assert parent[1, 2] == 0 and parent[1, 4] == 3 and parent[1, 5] == 1 and parent[1, 6] == 4
    assert all(parent[k] is None for k in parent if k not in {(1, 2), (1, 4), (1, 5), (1, 6)})
    assert found[1, 6]["root"] == 3 and found[1, 2]["root"] == 0 and found[1, 7]["root"] == 7
    assert found[1, 4]["text"] == "to the third" and found[1, 6]["n_quotes"] == 2
    ordered = reply_ordered(spark.createDataFrame(rows, SCHEMA)).where("conv = 1 and turn is not null").collect()
    assert [r["turn"] for r in ordered] == [0, 2, 1, 5, 3, 4, 6, 7, 8]
    assert sum(1 for _ in link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()) == len(rows)


def test_long_chain_and_empty_table(spark):
    rng = random.Random(9)
    rows = [(1, 0, "user", prose(rng, 12))]
    for i in range(1, 40):
        rows.append((1, i, "user", f"> {rows[-1][3].splitlines()[-1]}\n{prose(rng, 12)}"))
    found = links(spark, rows)
    assert {r["root"] for r in found.values()} == {0} and all(found[1, i]["parent"] == i - 1 for i in range(1, 40))
    assert links(spark, []) == {}
