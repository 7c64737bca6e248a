import random

from assayer.llm import queries, quotation

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def test_nested_levels_and_attributions():
    text = "Hi,\nOn Monday, Ann wrote:\n> I agree.\n> Fully.\n>> What now?\n> > And then?\n\nMy answer\n> I agree.\n"
    assert quotation.parse(text) == ("Hi,\n\nMy answer", [(1, "I agree.\nFully."), (2, "What now?\nAnd then?"), (1, "I agree.")])
    assert quotation.parse(None) == ("", []) and quotation.parse("") == ("", [])
    assert quotation.parse("a > b\n1 >= 0") == ("a > b\n1 >= 0", [])


def test_links_threads_and_odd_rows(spark):
    rows = [
        (1, 0, "user", "What is the plan?\nTell me all."),
        (1, 1, "assistant", "First we build.\nThen we test.\nThen we rest."),
        (1, 2, "user", "> Then we test.\nHow long?"),
        (1, 3, "assistant", "Bob wrote:\n>> what is THE plan\n> Nobody said this\nNew branch"),
        (1, 4, "user", "> First we build.\n> Then we test.\nand so?"),
        (1, 5, "user", None),
        (2, 0, "user", "> Then we test.\n"),
        (2, 2, "user", "alone"),
        (None, 1, "user", "no conversation"),
        (3, None, "user", "> no turn"),
        (4, 0, "user", "same"),
        (4, 0, "user", "same"),
        (4, 1, "user", "> same\n" * 3000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = quotation.link(df).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    reply = {k: (r["reply_to"], r["quoted"], r["depth"], r["position"]) for k, r in by.items()}
    assert reply == {
        (1, 0): (None, False, 0, 0), (1, 1): (0, False, 1, 1), (1, 2): (1, True, 2, 2), (1, 3): (0, True, 1, 5), (1, 4): (1, True, 2, 3), (1, 5): (4, False, 3, 4),
        (2, 0): (None, False, 0, 0), (2, 2): (0, False, 1, 1), (None, 1): (None, False, None, None), (3, None): (None, False, None, None), (4, 0): (None, False, 0, 0), (4, 1): (0, True, 1, 1),
    }
    assert [by[1, t]["text"] for t in (2, 3, 5)] == ["How long?", "New branch", None]
    assert by[1, 3]["levels"] == 2 and by[1, 4]["n_linked"] == 3
    assert quotation.link(df.limit(0)).count() == 0


def test_query_keeps_every_message_after_what_it_answers(spark):
    source = {(r["conv_id"], r["turn"]): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    rows = queries.op7_quotation_links(spark, SF).collect()
    assert {(r["conv_id"], r["turn"]) for r in rows} == set(source) and len(rows) == len(source)
    for r in rows:
        own, _ = quotation.parse(source[r["conv_id"], r["turn"]]["text"])
        assert r["text"] == own
        assert r["reply_to"] is None or (r["reply_to"] < r["turn"] and (r["conv_id"], r["reply_to"]) in source)


def brute(messages):
    """(reply_to, quoted, depth, position, n_linked) of each (conversation, turn), by looking for the words themselves and walking the trees."""
    out = {}
    for conv in {c for c, _ in messages}:
        turns = sorted(t for c, t in messages if c == conv)
        own = {t: f" {quotation.normalised(quotation.parse(messages[conv, t])[0])} " for t in turns}
        replies, n_linked = {}, {}
        for place, t in enumerate(turns):
            asked = set()
            for level, passage in quotation.parse(messages[conv, t])[1]:
                lines = [x for x in passage.split("\n") if quotation.normalised(x)]
                asked.add((level, quotation.normalised(passage), 2 * len(passage)))
                asked |= {(level, quotation.normalised(x), len(x)) for x in lines if len(lines) > 1}
            found = {}
            for level, words, weight in asked:
                original = next((o for o in turns if f" {words} " in own[o]), t)
                if original < t:
                    least, sum_, n = found.get(original, (level, 0, 0))
                    found[original] = (min(least, level), sum_ + weight, n + 1)
            best = max(found, key=lambda o: (-found[o][0], found[o][1], o), default=None)
            replies[t] = best if best is not None else turns[place - 1] if place else None
            n_linked[t] = (best is not None, sum(n for _, _, n in found.values()))
        order, stack = [], [(turns[0], 0)]
        while stack:
            t, depth = stack.pop()
            order.append((t, depth))
            stack += [(u, depth + 1) for u in reversed(turns) if replies[u] == t]
        for position, (t, depth) in enumerate(order):
            out[conv, t] = (replies[t], n_linked[t][0], depth, position, n_linked[t][1])
    return out


def test_links_and_order_match_brute_force(spark):
    rng = random.Random(2)
    messages = {}
    for conv, size in [(1, 160), *((c, rng.randint(1, 12)) for c in range(2, 60))]:
        turns = sorted(rng.sample(range(3 * size), size))
        for i, t in enumerate(turns):
            lines = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(1, 4))]
            for _ in range(rng.choice([0, 0, 1, 1, 2]) if i else 0):
                words = quotation.parse(messages[conv, rng.choice(turns[:i])])[0].split()
                a = rng.randrange(len(words))
                words = words[a : a + rng.randint(1, 12)]
                k = rng.randint(1, 5)
                mark = rng.choice(["> ", ">> ", "> "])
                lines = [mark + " ".join(words[j : j + k]) for j in range(0, len(words), k)] + [""] + lines
            messages[conv, t] = "\n".join(lines)
    df = spark.createDataFrame([(*k, "user", v, "x") for k, v in messages.items()], SCHEMA).repartition(4)
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["quoted"], r["depth"], r["position"], r["n_linked"]) for r in quotation.link(df).collect()}
    want = brute(messages)
    assert got == want and sum(x[1] for x in want.values()) > 100 and len({x[2] for x in want.values()}) > 10


def test_answers_far_apart_and_deep_nests(spark):
    # each message quotes the one two turns before, so that chains hang on chains; another conversation has all on its first
    rows = [(1, 10 * k, "user", f"> body number {k - 2}\nbody number {k}" if k > 1 else f"body number {k}", "x") for k in range(70)]
    rows += [(2, k, "user", f"> the first\nanswer {k}" if k else "the first", "x") for k in range(70)]
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["depth"], r["position"]) for r in quotation.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {k: (v[0], v[2], v[3]) for k, v in brute({(r[0], r[1]): r[3] for r in rows}).items()}
    assert got == want and got[1, 20] == (0, 1, 36) and got[2, 69] == (0, 1, 69)


def test_any_run_of_words_is_found_whatever_its_length_and_wrapping(spark):
    lines = [f"Line {k} speaks of topic{k}, and of matter{k} too." for k in range(8)]
    words = " ".join(lines[1:7]).split()
    wrapped = "\n".join("> " + " ".join(words[k : k + 5]) for k in range(0, len(words), 5))
    rows = [
        (1, 0, "user", "\n".join(lines)),
        (1, 1, "assistant", "Something else.\nNot in question."),
        (1, 2, "user", "Again.\n" + "\n".join("> " + x for x in lines[2:7])),
        (1, 3, "assistant", wrapped + "\nYes"),
        (1, 4, "user", "> of matter5 too\nPart of a line"),
        (1, 5, "user", "> of matter5 speaks\nNot there"),
        (2, 1, "user", "> of matter5 too\nAnother conversation"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["quoted"]) for r in quotation.link(df).collect()}
    assert [got[1, t] for t in (2, 3, 4, 5)] == [(0, True), (0, True), (0, True), (4, False)] and got[2, 1] == (None, False)
    text = [f"w{k % 7}" for k in range(40)]
    for size, found in quotation.runs(text, [1, 3, 40, 41]):
        names = [" ".join(text[i : i + size]) for i in range(41 - size)]
        assert len(set(zip(names, found.tolist(), strict=True))) == len(set(names)) == len(set(found.tolist()))
