from trussline.llm import quotes

KIND = "conv_id long, turn long, role string, text string, branch string, quotes string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], KIND)


def by_turn(df):
    return {(r.conv_id, r.turn): r for r in df.collect()}


def test_parse():
    body, found = quotes.parse_quotes("Hi\nOn Monday Bob wrote:\n> one\n> two\n>> deep\nOk\n> three")
    assert body == "Hi\nOk" and found == [(1, "one\ntwo"), (2, "deep"), (1, "three")]
    assert quotes.parse_quotes(None) == ("", []) and quotes.parse_quotes("a\n\nb") == ("a\n\nb", [])
    assert quotes.parse_quotes("> > x") == ("", [(2, "x")])
    assert quotes.parse_quotes("a > b\nI wrote:\nmore") == ("a > b\nI wrote:\nmore", [])


def test_links_branches_and_texts(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"),
        (1, 1, "assistant", "Fine, thanks.\nAnd you?"),
        (1, 2, "user", "On Monday Bob wrote:\n> Fine,  thanks.\n> And you?\nGreat."),
        (1, 3, "assistant", "> HOW are you?\nVery well, in fact."),
        (1, 4, "user", ">> How are you?\n> Very well, in fact.\nNice"),
        (1, 5, "user", "> nobody said\nhm"),
        (2, 0, "user", None),
        (2, 5, None, "Fine, thanks."),
        (2, 5000, "user", "> Fine, thanks.\nok"),
        (2, 5000, "user", "> Fine, thanks.\nok"),
        (None, 1, None, "a"),
        (3, None, "user", "> Fine, thanks."),
    ]
    got = by_turn(quotes.format_conversations(table(spark, rows)))
    assert len(got) == 11
    assert {k: (r.branch, r.reply_to, r.n_quotes, r.n_linked) for k, r in got.items()} == {
        (1, 0): (0, None, 0, 0),
        (1, 1): (0, 0, 0, 0),
        (1, 2): (0, 1, 1, 1),
        (1, 3): (3, 0, 1, 1),
        (1, 4): (3, 3, 2, 2),
        (1, 5): (3, 4, 1, 0),
        (2, 0): (0, None, 0, 0),
        (2, 5): (0, 0, 0, 0),
        (2, 5000): (0, 5, 1, 1),
        (None, 1): (None, None, 0, 0),
        (3, None): (None, None, 1, 0),
    }
    assert got[1, 2].text == "Great." and got[2, 5].formatted == "<|im_start|>user\nFine, thanks.<|im_end|>\n"


def test_long_conversations_and_chains(spark):
    rows = [(7, k, "user", f"text {k}") for k in range(0, 4000, 3)] + [(8, k, "user", f"say {k}" if k % 5 else f"> say {max(k - 4, 1)}\nsay {k}") for k in range(60)]
    got = by_turn(quotes.format_conversations(table(spark, rows)))
    assert all(r.reply_to == (k[1] - 3 if k[1] else None) for k, r in got.items() if k[0] == 7)
    parent = {k[1]: r.reply_to for k, r in got.items() if k[0] == 8}
    assert all(p < k for k, p in parent.items() if p is not None)
    children = {}
    for k in sorted(parent):
        children.setdefault(parent[k], []).append(k)
    head = {}
    for k in sorted(parent):
        first = parent[k] is not None and children[parent[k]][0] == k
        head[k] = head[parent[k]] if first else k
    assert {k[1]: r.branch for k, r in got.items() if k[0] == 8} == head


def test_the_whole_table(tables):
    messages = tables("conversations")
    got = quotes.format_conversations(messages)
    assert got.count() == messages.distinct().count() and got.filter("branch is null or n_linked > n_quotes").count() == 0
    assert quotes.format_conversations(messages.limit(0)).count() == 0


def brute_links(rows):
    """For each passage the latest earlier message of its conversation that holds it, by looking into every one."""
    parsed = [(c, t, *quotes.parse_quotes(text)) for c, t, _, text in dict.fromkeys(rows) if c is not None and t is not None]
    out = set()
    for c, t, _, found in parsed:
        for place, (level, passage) in enumerate(found):
            want, lines = quotes.normalised(passage), quotes._lines(passage)
            if not want:
                continue
            held = []
            for c2, t2, body, _ in parsed:
                if c2 == c and t2 < t:
                    own = quotes._lines(body)
                    parts = [body, *quotes.re.split(r"\n\s*\n", body), *body.split("\n")]
                    if want in map(quotes.normalised, parts) or any(own[k : k + len(lines)] == lines for k in range(len(own))):
                        held.append(t2)
            if held:
                out.add((c, t, level, place, max(held)))
    return out


def test_links_equal_a_brute_force_linker(spark):
    import random

    r = random.Random(6)
    lines = ["yes", "No way", "the cat  sat", "one two", "", "Thanks,", "see below", "ok then"]
    rows = []
    for c in range(12):
        said = []
        for t in range(0, 5000 if c == 0 else 40, 90 if c == 0 else 1):
            text = []
            if said and r.random() < 0.7:
                source = r.choice(said).split("\n")
                k = r.randrange(len(source))
                text = [r.choice(["> ", ">", ">> "]) + line.upper() for line in source[k : k + r.randrange(1, 5)]]
            body = "\n".join(r.choice(lines) for _ in range(r.randrange(1, 7)))
            said.append(body)
            rows.append((c, t, "user", "\n".join([*text, body])))
    parsed = quotes._parsed(table(spark, rows))
    assert {tuple(x) for x in quotes.quote_links(parsed).select("conv_id", "turn", "level", "place", "origin").collect()} == brute_links(rows)


def test_a_trimmed_reply_finds_its_message(spark):
    rows = [(1, 0, "user", "a\nb\nc\nd\ne"), (1, 1, "user", "other"), (1, 2, "user", "> b\n> c\nyes"), (1, 3, "user", "> c\n> b\nno")]
    got = by_turn(quotes.format_conversations(table(spark, rows)))
    assert got[1, 2].reply_to == 0 and got[1, 2].n_linked == 1 and got[1, 3].n_linked == 0


def test_a_line_that_many_turns_share(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "'user' as role", "if(id % 2 = 0, 'yes', '> yes\n> yes\nno') as text")
    links = quotes.quote_links(quotes._parsed(rows.withColumn("text", quotes.F.expr("if(turn % 2 = 0, 'yes\nyes', text)"))))
    got = links.selectExpr("count(*) as n", "sum(if(origin = turn - 1, 1, 0)) as good").first()
    assert tuple(got) == (n // 2, n // 2)


def test_runs_are_found_by_either_end():
    runs = quotes.Runs([f"line {k}" for k in range(9)])
    ask = lambda at, n, tail: {"lines": n, "run": runs.name(at, n), "anchor": runs.name(at + n - 4 if tail else at, 4), "at": n - 4 if tail else 0}
    asked = [ask(0, 4, False), ask(2, 7, True), ask(1, 6, False)]
    lines = [f"line {k}" for k in range(9)]
    assert quotes.held_runs(lines, asked) == {a["run"] for a in asked}
    assert quotes.held_runs(lines[:8], asked) == {asked[0]["run"], asked[2]["run"]}
    assert quotes.held_runs([], asked) == set() and [quotes.half(n) for n in (1, 2, 3, 4, 7, 8)] == [1, 2, 2, 4, 4, 8]


def test_a_long_message_quoted_in_all_sizes_costs_linear_rows(spark):
    n = 1500
    lines = [f"line {k}" for k in range(n)]
    rows = [(1, 0, "user", "\n".join(lines))] + [(1, k, "user", "\n".join("> " + x for x in lines[:k]) + f"\nanswer {k}") for k in range(2, n + 1)]
    parsed = quotes.stored(quotes._parsed(table(spark, rows)), "parsed")
    asked = parsed.select("conv_id", quotes.F.explode("quotes").alias("q")).select("conv_id", "q.*").withColumn("half", quotes.F.expr("shiftleft(1, cast(floor(log2(lines)) as int))"))
    assert quotes._blocks(parsed, asked).count() <= 2 * n
    got = quotes.quote_links(parsed)
    assert got.count() == n - 1 and got.filter("origin <> 0").count() == 0
