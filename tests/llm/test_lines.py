import re
from collections import defaultdict

from tracewarden.llm import lines

SCHEMA = "doc_id long, text string, n_lines string, leaf long"


def masked(line):
    tokens = re.sub(r"[ \t\x0b\f\r]+", " ", line).split(" ")
    return tuple("<*>" if re.search(r"[0-9@]|://", t) else t for t in tokens if t)


def recurring_by_hand(texts, depth, min_tokens, min_docs, similarity, long_tokens):
    """The masked lines of recurring templates: equal lines, leaves that agree, and groups within leaves."""
    seen = defaultdict(set)
    for text in texts:
        for line in text.split("\n"):
            if len(tokens := masked(line)) >= min_tokens:
                seen[tokens].add(text)
    leaves = defaultdict(list)
    for tokens in seen:
        leaves[len(tokens), tokens[:depth]].append(tokens)
    gone = {t for t, where in seen.items() if len(where) >= (min(2, min_docs) if sum(x != "<*>" for x in t) >= long_tokens else min_docs)}
    for (size, _), own in leaves.items():
        if len(own) < 2 or len(set().union(*(seen[t] for t in own))) < min_docs:
            continue
        positions = range(depth, size)
        if not positions:
            continue
        texts_at = [defaultdict(int) for _ in range(size)]
        for t in own:
            for i in positions:
                texts_at[i][t[i]] += len(seen[t])
        if sum(len(texts_at[i]) == 1 for i in positions) >= similarity * len(positions):
            gone.update(own)
        total = sum(len(seen[t]) for t in own)
        groups = defaultdict(set)
        for share in lines.LEVELS:
            for t in own:
                kept = tuple((i, t[i]) for i in positions if texts_at[i][t[i]] >= max(min_docs, share * total))
                if len(kept) >= similarity * len(positions):
                    groups[kept].add(t)
        for group in groups.values():
            if len(group) > 1 and len(set().union(*(seen[t] for t in group))) >= min_docs:
                gone.update(group)
    return gone


def brute(rows, depth=3, min_tokens=4, min_docs=5, similarity=0.7, long_tokens=50):
    gone = recurring_by_hand({t for _, t in rows if t is not None}, depth, min_tokens, min_docs, similarity, long_tokens)
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        keep = [line for line in text.split("\n") if masked(line) not in gone]
        n = len(text.split("\n"))
        out.append((i, "\n".join(keep), n, n - len(keep)))
    return sorted(out, key=repr)


def rows():
    out = []
    for i in range(40):
        text = [f"unique thought number{chr(97 + i % 26)} of writer {chr(97 + i // 26)} goes here and ends", "", "short line"]
        if i % 2:
            text.append(f"Posted by user{i} on 2024-01-{i:02d} at home")
        if i % 3 == 0:
            text.insert(0, f"Order of the day is {'abcdefghij'[i % 10] * 3} for everyone who reads this")
        if i % 5 == 0:
            text.append("  All   rights reserved\tby nobody at all  ")
        out.append((i, "\n".join(text)))
    return [*out, (100, None), (101, ""), (102, out[3][1]), (3, out[3][1]), (None, "\n\n"), (103, "All rights reserved by nobody at all\n" * 300)]


def test_against_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA)
    got = lines.drop_recurring_lines(docs)
    assert got.columns == ["doc_id", "text", "leaf", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()), key=repr) == brute(data)
    shown = {r["template"] for r in lines.templates(docs).collect()}
    assert {"Posted by <*> on <*> at home", "All rights reserved by nobody at all", "Order of the day is <*> for everyone who reads this"} <= shown


def test_copies_of_one_text_are_not_a_template(spark):
    docs = spark.createDataFrame([(i, "a line that is only in one text", "", 0) for i in range(50)], SCHEMA)
    assert {r["n_dropped"] for r in lines.drop_recurring_lines(docs).collect()} == {0}


def test_empty_table_and_plan(spark):
    docs = spark.createDataFrame(rows()[:5], "doc_id long, text string")
    assert lines.drop_recurring_lines(docs.limit(0)).count() == 0
    plan = lines.drop_recurring_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval"))


def dropped(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["n_dropped"] for r in lines.drop_recurring_lines(docs).collect()}


NAMES = "ada bob cyd dan eve fay gus hal ida jon kay lee".split()


def test_a_template_is_found_beside_other_lines_of_its_leaf(spark):
    texts = [f"own {n}\nthe order of {n} was shipped on time to {m}" for n in NAMES for m in NAMES[:3]]
    texts += [f"own {n}\nthe order of {n} {n}ing stars {n}er far {n}ish above {n}ly" for n in NAMES]
    got = dropped(spark, texts)
    assert [got[i] for i in range(36)] == [1] * 36
    mixed = [f"x {n}\nthe order of things here was {n} shipped on time" for n in NAMES] + ["the order of things never said what was really meant"]
    got = dropped(spark, mixed)
    assert [got[i] for i in range(13)] == [1] * 12 + [0]


def test_leading_tokens_are_no_agreement_and_one_text_is_no_crowd(spark):
    assert set(dropped(spark, [f"own {n}\nI want to {n}" for n in NAMES]).values()) == {0}
    assert dropped(spark, ["\n".join(f"see you at {n} for tea and cake" for n in NAMES), "other"]) == {0: 0, 1: 0}


def test_long_lines_need_two_texts(spark):
    long, short = (" ".join(f"{a}{b}" for a in NAMES for b in NAMES[:n]) for n in (5, 2))
    numbers = " ".join(str(i) for i in range(60))
    texts = [f"{long}\n{short}\n{numbers}\nfirst", f"{long}\n{short}\n{numbers}\nsecond", "third"]
    assert dropped(spark, texts) == {0: 1, 1: 1, 2: 0}


def test_lines_are_parsed_once(spark):
    parsed = lines._parsed(spark.createDataFrame([("a",)], "text string"), "text", 3, 4)
    assert parsed._jdf.queryExecution().executedPlan().toString().count("RLIKE") == 1


def test_parsed_lines_are_their_masked_tokens(spark):
    odd = ["", " ", "a", " a  b ", "a\tb\r", "a\x0bb\x0cc", "x:y :// a://b ://", "5 a5 5a a@b <*> <*><*>", "\u00a0 \u2003a\x85b c", "a  b c  d5 ", "\u0665 é:1 \U0001f600 :", "<*> b c", "5 b c", "b b c", "a b  c", "a b\tc"]
    text = "\n".join([*odd, *(f"{a} {b}" for a in odd for b in odd)])
    for least in (0, 1, 4):
        got = lines._parsed(spark.createDataFrame([(text,), (None,)], "text string"), "text", 3, least).collect()
        want = {i: masked(line) for i, line in enumerate(text.split("\n"))}
        want = {i: tokens for i, tokens in want.items() if len(tokens) >= least}
        assert {r["number"]: (r["words"], r["size"], r["masked"]) for r in got} == {
            i: (sum(x != "<*>" for x in tokens), len(tokens), " ".join(tokens)) for i, tokens in want.items()
        }
        number_of = {r["number"]: (r["leaf"], r["line"]) for r in got}
        assert len({line for _, line in number_of.values()}) == len(set(want.values()))
        assert len({leaf for leaf, _ in number_of.values()}) == len({(len(tokens), tokens[:3]) for tokens in want.values()})
