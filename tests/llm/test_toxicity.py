import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from assayer.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op10_toxic_grammar(spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    caught = sum(p and t for p, t in held) / sum(t for _, t in held)
    spared = sum(not p and not t for p, t in held) / sum(not t for _, t in held)
    assert caught > 0.85 and spared > 0.99


def features(text):
    grammar = toxicity.Grammar()
    return dict(zip(toxicity.FEATURES, next(toxicity._document_features(grammar, pa.array([text]))), strict=True))


def test_clauses_are_scored_not_words():
    plain, negated, reported, targeted, apart = (features(t) for t in ("what a moron", "this is not a moron", "Ann said that he was a moron", "you are a moron", "you left. a moron"))
    assert plain["hits"] > 0 and plain["negated"] == plain["reported"] == 0
    assert negated["hits"] == 0 and negated["negated"] > 0
    assert reported["hits"] == 0 and reported["reported"] > 0
    assert targeted["targeted"] > 0 and apart["targeted"] == 0
    assert features("moron you are")["targeted"] > 0
    assert features("I will kill you")["threats"] > features("I will kill time")["threats"] > 0


def test_composition_is_one_transducer_after_the_other():
    rng = np.random.default_rng(1)
    parts = [toxicity.marking(toxicity.NEGATION, "negated", 3), toxicity.marking(toxicity.REPORT, "reported", 8), toxicity.marking(toxicity.TARGET, "targeted", 4)]
    for _ in range(50):
        word = [(int(k), frozenset(), 1.0) for k in rng.integers(0, 7, 20)]
        assert toxicity.FORWARD(word) == parts[2](parts[1](parts[0](word)))


def brute(grammar, text):
    """The score by reading every word of every clause and looking for what stands near it."""
    classes, clause_ends = [], []
    for chunk in re.split(r"\s", text):
        words = toxicity.LETTERS.findall(chunk.lower())
        for word in words or [""]:
            if word in toxicity.THREATS:
                classes.append(("threat", grammar.words.get(word, 1.0)))
            elif (weight := grammar.insult(word)) is not None:
                classes.append(("insult", weight))
            else:
                classes.append((next((n for n, own in (("target", toxicity.TARGETS), ("not", toxicity.NEGATIONS), ("report", toxicity.REPORTS), ("intent", toxicity.INTENTS)) if word in own), ""), 0.0))
            clause_ends.append(False)
        clause_ends[-1] = chunk[-1:] in toxicity.ENDS
    sums, matched, strongest, start = collections.Counter(), 0, 0.0, 0
    for end in [i + 1 for i, e in enumerate(clause_ends) if e] + [len(classes)]:
        clause, score = classes[start:end], 0.0
        for i, (kind, weight) in enumerate(clause):
            if kind in ("threat", "insult"):
                before = lambda what, n, i=i, clause=clause: any(k == what for k, _ in clause[max(0, i - n) : i])
                aimed = before("target", 4) or any(k == "target" for k, _ in clause[i + 1 : i + 5])
                if before("not", 3) or before("report", 8):
                    sums["negated" if before("not", 3) else "reported"] += weight
                elif kind == "threat":
                    sums["threats"] += (own := weight * (0.5 + 0.5 * before("intent", 3) + aimed))
                    score += own
                else:
                    sums["hits"], sums["targeted"], score = sums["hits"] + weight, sums["targeted"] + weight * aimed, score + weight * (1 + aimed)
        matched, strongest, start = matched + any(k in ("threat", "insult") for k, _ in clause), max(strongest, score), end
    found = [*(sums[k] for k in ("hits", "targeted", "negated", "reported", "threats")), 100 * matched / (sum(clause_ends) + 1), strongest]
    return 1 / (1 + math.exp(-sum(w * x for w, x in zip(grammar.weights, [1.0, *map(math.log1p, found)], strict=True))))


def test_scores_match_brute_force(spark):
    rng = random.Random(4)
    grammar = toxicity.Grammar({"grumf": 2.5, "kill": 1.7}, {"blar": 1.2, "blargo": 2.2}, (-1.0, 0.4, 0.3, -0.2, -0.1, 0.5, 0.2, 0.1))
    some = ["idiot", "grumf", "blarx", "blargon", "kill", "hurt", "you", "they", "not", "said", "will", "house", "and", "of", "tree", "x1", "--", "wer,idiot", "not/kill"]
    texts = [" ".join(rng.choice(some if rng.random() < 0.4 else ["house", "of", "stone", "tree"]) + rng.choice(["", "", "", "", ".", ";", ","]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), grammar, ["doc_id"]).collect()}
    for i, text in enumerate(texts):
        assert abs(got[i] - brute(grammar, text)) < 1e-9, text
    assert len({round(x, 3) for x in got.values()}) > 100


def test_marks_decide(spark):
    grammar = toxicity.Grammar()
    by = {t: brute(grammar, t) for t in ("what a moron", "this is not a moron", "Ann said that he was a moron", "you are a moron")}
    got = {r["text"]: r["score"] for r in toxicity.score(spark.createDataFrame([(t,) for t in by], "text string").selectExpr("text", "text as copy"), grammar, ["text"], "copy").collect()}
    assert all(abs(got[t] - s) < 1e-9 for t, s in by.items())
    assert got["you are a moron"] > got["what a moron"] > 0.5 > got["Ann said that he was a moron"] > got["this is not a moron"]


def test_copies_of_one_document_give_no_lexicon(spark):
    rng = np.random.default_rng(3)
    clean = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 40)) for _ in range(300)]
    same = "the quarterly topics are zebrafish and marmalade, " + " ".join(f"t{k}" for k in range(60))
    toxic = [f"{same} copy{i}" for i in range(60)] + [f"{t} grumfel" for t in clean[:60]]
    grammar = toxicity.learn(spark.createDataFrame([(t, 0) for t in clean] + [(t, 1) for t in toxic], "text string, label int"))
    assert "grumfel" in grammar.words and "zebrafish" not in grammar.words and "marmalade" not in grammar.words


def test_learned_stems_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    clean = [f"w{rng.integers(1000)} " * 5 + "house garden" for _ in range(300)]
    toxic = [f"{t} grumf{'abcde'[i % 5]} ." for i, t in enumerate(clean[:120])]
    rows = [(t, 0) for t in clean] + [(t, 1) for t in toxic] + [(None, 0), ("", 0), ("x", None)]
    grammar = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert "grumf" in grammar.stems
    probes = [(1, "a grumfo ."), (2, "house garden"), (3, None), (4, ""), (None, "grumfa"), (None, "grumfa"), (5, "house " * 50_000)]
    df = spark.createDataFrame([(*p, 0.5) for p in probes], "doc_id long, text string, score double")
    got = toxicity.score(df, grammar, ["doc_id"]).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 7 and by[1] > 0.5 and by[None] > 0.5 and max(by[k] for k in (2, 3, 4, 5)) < 0.5
    assert sorted(r["doc_id"] for r in toxicity.accepted(df, grammar).where("doc_id is not null").collect()) == [2, 3, 4, 5]
    assert toxicity.accepted(df, grammar).columns == df.columns
    empty = spark.createDataFrame([], "text string, label int")
    assert toxicity.learn(empty) == toxicity.Grammar() and toxicity.score(df.limit(0), grammar, ["doc_id"]).count() == 0


def test_every_word_is_read_whatever_separates_it():
    plain = features("you idiot")
    for text in ("you\tidiot", "you\u00a0idiot", "you\u3000idiot", "you\ridiot", "you\r\nidiot", "you/idiot", "you,idiot"):
        assert features(text) == plain and plain["targeted"] > 0
    assert features("well,idiot")["hits"] == features("well idiot")["hits"] > 0
    assert features("you left.\r\na moron")["targeted"] == features("you left.\ra moron")["targeted"] == 0
    assert features("not,a,moron")["negated"] > 0 and features("not,a,moron")["hits"] == 0
