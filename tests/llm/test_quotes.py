"""Quotation threads on written examples."""

from paritas.llm import quotes


def rows(df):
    return {(r.conv_id, r.turn, r.own_text): r for r in df.collect()}


def test_passages(sp):
    text = "> > old line\n> > goes on\n>\n> new\n\nmine one\nmine two\n\n  \nmine three\n>>deep"
    df = sp.createDataFrame([(text,), (None,), ("",), ("\n \n",)], "t string")
    got = [[(p.level, p.text) for p in r[0]] for r in quotes.with_passages(df, "t", "p").select("p").collect()]
    assert got == [[(2, "old line\ngoes on"), (1, "new"), (0, "mine one\nmine two"), (0, "mine three"), (2, "deep")], [], [], []]


def test_threads(sp):
    m = [(1, 0, "Hello  World\n\nsecond part"), (1, 1, "> hello world\n\nyes"), (1, 2, ">> Hello World\n> YES\n\nno"),
         (1, 3, "> second part\n\nlate"), (1, 4, "> nobody said this\n\nalone"), (2, 0, "> yes\n\nelsewhere"),
         (2, 1, None), (2, 2, ""), (2, 3, "> late\n> > x\n\nend"), (0, 9, "> end\n\nbefore the end"), (3, 0, "again"), (3, 1, "again"), (3, 2, "> again\n\nok")]
    df = sp.createDataFrame([(*x, "u", 1) for x in m], "conv_id bigint, turn bigint, text string, role string, depth int")
    got = rows(quotes.conversations(df))
    place = {k[:2]: ((r.parent_conv, r.parent_pos), (r.root_conv, r.root_pos), r.depth, r.n_quoted, r.n_linked) for k, r in got.items()}
    none = (None, None)
    assert place == {
        (1, 0): (none, (1, 0), 0, 0, 0), (1, 1): ((1, 0), (1, 0), 1, 1, 1), (1, 2): ((1, 1), (1, 0), 2, 2, 2),
        (1, 3): ((1, 0), (1, 0), 1, 1, 1), (1, 4): (none, (1, 4), 0, 1, 0), (2, 0): ((1, 1), (1, 0), 2, 1, 1),
        (2, 1): (none, (2, 1), 0, 0, 0), (2, 2): (none, (2, 2), 0, 0, 0), (2, 3): ((1, 3), (1, 0), 2, 2, 1),
        (0, 9): (none, (0, 9), 0, 1, 0), (3, 0): (none, (3, 0), 0, 0, 0), (3, 1): (none, (3, 1), 0, 0, 0), (3, 2): ((3, 0), (3, 0), 1, 1, 1)}
    assert {k[2] for k in got} >= {"yes", "no", None, "", "Hello  World\n\nsecond part"}


def test_long_chain_repeated_rows_and_nulls(sp, tmpdir_path):
    m = [(1, i, (f"> say {i - 1}\n\n" if i else "") + f"say {i}") for i in range(40)] + [(1, 7, "> say 6\n\nsay 7"), (None, 3, "say 5"), (4, None, "> say 5")]
    df = sp.createDataFrame(m, "conv_id bigint, turn bigint, text string")
    out = quotes.conversations(df)
    got = out.collect()
    assert len(got) == 43 and all(r.depth == r.turn and r.root_pos == 0 for r in got if r.conv_id == 1)
    assert [r.parent_conv for r in got if r.conv_id == 4] == [None] or [r.parent_pos for r in got if r.conv_id == 4] == [5]
    quotes.write_threads(out, f"{tmpdir_path}/threads")
    assert sp.read.parquet(f"{tmpdir_path}/threads").count() == 43
    assert quotes.conversations(df.limit(0)).count() == 0


def test_common_passage_does_not_multiply(sp):
    m = [(i, 0, "same greeting") for i in range(300)] + [(i, 1, f"> same greeting\n\nanswer {i}") for i in range(300)]
    got = quotes.conversations(sp.createDataFrame(m, "conv_id bigint, turn bigint, text string")).collect()
    assert len(got) == 600 and all(r.parent_conv == r.conv_id for r in got if r.turn == 1)


def test_mail_from_turns(sp):
    df = sp.createDataFrame([(1, 0, "a\nb"), (1, 1, "c"), (1, 2, "d")], "conv_id bigint, turn bigint, text string")
    got = {r.turn: r.text for r in quotes.quoting_mail(df).collect()}
    assert got == {0: "a\nb", 1: "> a\n> b\nc", 2: ">> a\n>> b\n> c\nd"}
