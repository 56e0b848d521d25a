from collections import Counter

from taskloom.llm.quotations import link_quotations, normalised_hash, parse_message, units

A = "The first message.\nIt has two lines."
B = "Another thought on the matter\n\nwith a second paragraph here"


def quote(text, marks=">"):
    return "\n".join(f"{marks} {line}" for line in text.split("\n"))


ROWS = [
    (1, 0, A),
    (1, 1, B),
    (1, 2, f"On Monday, Ann wrote:\n{quote(A)}\nI agree."),
    (1, 3, f"{quote(quote(A))}\n{quote('I agree.')}\nSo do I."),
    (1, 4, "No quote at all"),
    (1, 5, f"{quote('with a SECOND   paragraph, here')}\nGood point"),
    (2, 0, "Opening"),
    (2, 1, f"{quote('It has two lines.')}\nfrom elsewhere"),
    (2, 2, f"{quote('never said by anyone')}\nhm"),
    (2, 2, f"{quote('never said by anyone')}\nhm"),
    (None, 0, "lost"),
    (3, None, "also lost"),
    (3, 0, None),
    (3, 1, ""),
]


def frame(spark, rows):
    schema = "conv_id long, turn long, text string, role string, row string, body string, unit string"
    return spark.createDataFrame([(*r, "user", "row", "body", "unit") for r in rows], schema)


def brute(rows):
    """Parent and number of links of each row, by looking at all earlier rows."""
    placed = [(c, t, *parse_message(x)) for c, t, x in rows]
    holders = {}
    for c, t, body, _ in placed:
        if c is not None and t is not None:
            for u in units(body.split("\n")):
                holders.setdefault(u, set()).add((c, t))
    out = []
    for c, t, body, passages in placed:
        parent, linked = None, 0
        if c is not None and t is not None:
            earlier = {b for a, b, _, _ in placed if a == c and b is not None and b < t}
            parents = []
            for level, lines in passages:
                own = [max((b for a, b in holders.get(u, ()) if a == c and b < t), default=None) for u in units(lines)]
                own = [x for x in own if x is not None]
                other = [u for u in units(lines) if len(holders.get(u, ())) == 1 and not {a for a, _ in holders[u]} & {c}]
                linked += bool(own or other)
                if own and level == 1:
                    parents.append(own[0])
            parent = max(parents) if parents else max(earlier, default=None)
        out.append((str(c), str(t), body, len(passages), linked, str(parent)))
    return sorted(out)


def test_links_equal_brute_force(spark):
    rows = link_quotations(frame(spark, ROWS)).collect()
    got = sorted((str(r.conv_id), str(r.turn), r.body, r.n_quotes, r.n_linked, str(r.parent_turn)) for r in rows)
    assert got == brute(ROWS)


def test_reply_order_and_sources(spark):
    rows = link_quotations(frame(spark, ROWS)).collect()
    one = sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.reply_path)
    assert [r.turn for r in one] == [0, 2, 3, 4, 1, 5]
    by = {(r.conv_id, r.turn): r for r in rows}
    assert (by[(2, 1)].quoted_conv_id, by[(2, 1)].quoted_turn, by[(2, 1)].parent_turn) == (1, 0, 0)
    assert by[(1, 2)].body == "I agree." and by[(1, 3)].n_linked == 2
    assert by[(3, 0)].body == "" and by[(3, 1)].parent_turn == 0
    assert by[(None, 0)].reply_path is None and by[(3, None)].reply_path is None
    assert Counter((r.conv_id, r.turn) for r in rows)[(2, 2)] == 2


def test_originals_that_occur_twice(spark):
    line = quote("It has two lines.")
    rows = [(1, 0, A), (1, 1, B), (2, 0, "Opening"), (2, 1, f"{line}\nfrom elsewhere"), (2, 2, f"{quote(A)}\nall of it")]
    # Conversation 0 says the line later than it quotes it, and conversation 2 says it later too.
    rows += [(0, 0, f"{line}\nfirst"), (0, 1, "It has two lines."), (2, 3, A)]

    def got(rows):
        return {(r.conv_id, r.turn): r[3:8] for r in link_quotations(frame(spark, rows)).collect() if r.n_quotes}

    once = got(rows)
    assert once == {(2, 1): (1, 1, 0, 0, 1), (2, 2): (1, 1, 1, 1, 0), (0, 0): (1, 1, None, 1, 0)}
    copies = [(c + 10, t, x) for c, t, x in rows if c == 1] + [(30, t, x) for c, t, x in rows if c == 1]
    assert got(rows + copies) == once


def test_outermost_level_may_be_deeper(spark):
    rows = [(1, 0, A), (1, 1, B), (1, 2, f"{quote(quote(A))}\nyes"), (1, 3, f"{quote(quote(A))}\n{quote('unknown')}\nno")]
    got = {r.turn: r for r in link_quotations(frame(spark, rows)).collect()}
    assert (got[2].parent_turn, got[2].quoted_conv_id, got[2].quoted_turn) == (0, 1, 0)
    # Here the outermost passage is of level 1 and has no original.
    assert (got[3].n_linked, got[3].parent_turn, got[3].quoted_turn) == (1, 2, None)


def test_empty_table(spark):
    assert link_quotations(frame(spark, [])).collect() == []


def test_long_conversation_uses_slices(spark):
    rows = [(7, t, f"line number {t % 50}") for t in range(0, 1500, 3)]
    rows += [(7, 1501, quote("line number 0")), (7, 1502, quote("line number 1"))]
    got = {r.turn: r.parent_turn for r in link_quotations(frame(spark, rows)).collect()}
    want = {t: max(u for u in range(0, 1500, 3) if u % 50 == k) for t, k in ((1501, 0), (1502, 1))}
    assert got[1501] == want[1501] and got[1502] == want[1502] and got[600] == 597


def test_normalising():
    assert normalised_hash("A  b, C!") == normalised_hash("a b c")
    assert normalised_hash(" ... ") is None
    assert units(["x y", "", "z"])[0] == normalised_hash("x y z")


def test_long_messages_are_read_once():
    lines = [f"plain line {i}" for i in range(300_000)] + [f"On {'x' * 500} wrote:", "", "> quoted", "On y wrote:", "end"]
    body, passages = parse_message("\n".join(lines))
    assert passages == [(1, ["quoted"])]
    assert body.endswith("plain line 299999\n\nOn y wrote:\nend")
    assert parse_message("\n" * 500_000 + "> q")[1] == [(1, ["q"])]
