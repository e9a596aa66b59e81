"""Quality rules, conversation repair, phrases, and searches of often repeated ids against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import pytest

from riskweave.functions.tails import binomial_at_most
from riskweave.llm import ann, dialogue, phrases, rules

DOCS = "doc_id long, text string, lang string, n_words string, kept string, stratum string"
LABELS = "doc_id long, quality int, toxic int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = collections.Counter(windows)
    covered = {i + s for i, w in enumerate(windows) if many[w] > 1 for s in range(3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines)}


def prose(r, n, junk=False):
    return "".join(r.choice("abcdefgé") * r.randrange(1, 4) + str(r.randrange(500)) + ("###" if junk and r.random() < 0.6 else "") + r.choice([" ", " ", " ", "\n", "\t"]) for _ in range(n))


def documents():
    r = random.Random(3)
    odd = [None, "", " \n\t", "a a a a", "x\nx\n \nx y\ny", "w " * 100, "é|<>&%$*#", prose(r, 20_000), "the same line\n" * 40]
    out = [(i, t, "en", "x", "y", "z") for i, t in enumerate(odd)] + [(None, "no id " + prose(r, 60, True), None, "x", "y", "z")]
    labels = [(999_999, 1, 0), (None, 0, 0), (100, None, 0)]
    for i in range(100, 900):
        bad = r.random() < 0.3
        out.append((i, prose(r, r.randrange(60, 90), bad), ["en", "en", "de", None][i % 4], "x", "y", "z"))
        labels.append((i, int(not bad), 0))
    return out + out[:3] + out[50:53], labels + [(101, 0, 0)]


def test_rules_equal_brute_force(spark):
    rows, labels = documents()
    got, tested = rules.judge(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["doc_id", "lang", "stratum", *rules.STATISTICS, "base_failed", "failed_rule", "kept"] and len(got.collect()) == len(rows)
    good = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            good[i] = good.get(i, True) and q >= 1
    docs = []
    for i, text, lang, *_ in rows:
        s = statistics(text or "")
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        level = {}
        for name, (top, bottom, factor, above, cutoffs) in rules.RULES.items():
            hits = [k for k, c in enumerate(cutoffs, 1) if (factor * s[top] > c * s[bottom] if above else factor * s[top] < c * s[bottom])]
            level[name] = min(hits, default=None)
        docs.append((i, lang or "und", s, failed, level, good.get(i), i is not None and hashlib.md5(str(i).encode()).hexdigest() < "8"))
    strata = {d[1] for d in docs if d[5] and not d[6] and not d[3]}
    first = {}
    for stratum in {d[1] for d in docs}:
        steps = []
        for name, rule in rules.RULES.items():
            share = math.inf
            for k in range(1, len(rule[4]) + 1):
                met = [d for d in docs if d[1] == stratum and d[6] and not d[3] and d[5] is not None and d[4][name] is not None and d[4][name] <= k]
                bad = sum(not d[5] for d in met)
                if bad:
                    share = min(share, bad / (len(met) + 1))
                    if share >= rules.LEAST_SHARE:
                        steps.append((-share, name, k))
        steps.sort()
        held = [d for d in docs if d[1] == stratum and d[5] and not d[6] and not d[3]]
        chosen = []
        for step in steps:
            trial = [*chosen, step]
            k = sum(any(d[4][n] is not None and d[4][n] <= c for _, n, c in trial) for d in held)
            if not held or binomial_at_most(k, len(held), rules.RISK) > rules.ALPHA / len(strata):
                break
            chosen = trial
        first[stratum] = chosen
    want = collections.Counter((i, *s.values(), failed, not failed and not any(level[n] is not None and level[n] <= c for _, n, c in first[stratum])) for i, stratum, s, failed, level, *_ in docs)
    assert collections.Counter((r["doc_id"], *[r[c] for c in rules.STATISTICS], r["base_failed"], r["kept"]) for r in got.collect()) == want
    assert any(first.values()) and tested.where("passes").count() == sum(map(len, first.values()))
    assert all(r["bound"] <= rules.RISK for r in tested.where("passes").collect())


def test_rules_without_labels_and_rows(spark):
    rows, _ = documents()
    none = spark.createDataFrame([], LABELS)
    judged, tested = rules.judge(spark.createDataFrame(rows[:20], DOCS), none)
    assert tested.count() == 0 and all(r["kept"] == (not r["base_failed"]) for r in judged.collect())
    assert rules.judge(spark.createDataFrame([], DOCS), none)[0].count() == 0


CONV = "conv_id long, turn long, role string, text string, score double"


def least(rows):
    """(cost, audit, roles with texts) of the cheapest repair, by recursion from the end."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserted < 3:
            role, after = dialogue._OTHER[state]
            c, a, t = best(i, after, inserted + 1)
            found.append((c + 3, "I" + a, ((role, ""), *t)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role[:1] in dialogue._NEXT[state]:
                    c, a, t = best(i + 1, dialogue._NEXT[state][role[:1]], 0)
                    found.append((c + more, "K" + a, ((role, text), *t)))
                other, after = dialogue._OTHER[state]
                c, a, t = best(i + 1, after, 0)
                found.append((c + 3 + more, "R" + a, ((other, text), *t)))
        return min(found, default=(math.inf, "", ()))

    return best(0, 0, 0)


def expected(rows):
    kept = [r for r in rows]
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marked = set(), []
    for _, role, text in kept:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [t for t, *_ in kept if t is not None]
    cost, audit, out = least(tuple(marked))
    faults = [f for *_, f in marked]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def test_repair_equals_recursion(spark):
    r = random.Random(8)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "unknown", "tool", "", None])
            text = r.choice(["Yes.", "No", "  ", "", None, "Why? ", "é!\n", "long " * 5000 + "end.", f"t{turn}."])
            rows.append((conv, r.choice([turn, turn, turn, None, turn + 1]), role, text, 1.0))
    given = spark.createDataFrame(rows, CONV).repartition(3)
    want, by_conv = {}, collections.defaultdict(list)
    for conv, turn, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by_conv[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, kept in by_conv.items():
        want[conv] = expected(kept) if kept else (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    got = {x["conv_id"]: tuple(x[c] for c in [*dialogue._SUMS, "audit", "repaired_sha256"]) for x in dialogue.report(given).collect()}
    assert got == want
    out = dialogue.repaired(dialogue.damaged(given)).where("edit <> 'D'").collect()
    for conv, values in want.items():
        placed = sorted((x["place"], x["role"], x["text"]) for x in out if x["conv_id"] == conv)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for _, role, _ in placed))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in placed).encode()).hexdigest() == values[-1]
    assert dialogue.report(spark.createDataFrame([], CONV)).count() == 0


def test_repair_faults_of_odd_endings(spark):
    """Only the six white spaces are passed over at a text's end; x, 0, b, c, backslashes and other blanks are words."""
    endings = ["", *" \t\n\x0b\x0c\r", "\x0b\x0c", "x", "0", "b", "c", "\\", "\\x0b", "\x1f", "\x85", "\xa0", "\u3000", "\u200b", "\x00"]
    texts = [body + end for body in ("", "Yes.", "No", "12:3") for end in endings]
    rows = spark.createDataFrame([(i, 1, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {x["conv_id"]: x["fault"] for x in dialogue.faults(rows).collect()}
    for i, text in enumerate(texts):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        assert got[i] == ("blank" if not bare else None if bare[-1] in ".!?" else "truncated"), repr(text)


def test_search_forgets_what_is_decided():
    """Of a conversation of 20,000 rows, the tree never holds more than a few edits."""
    most, edits = 0, []
    search = dialogue.Repair(lambda *x: edits.append(x[0]))
    r = random.Random(2)
    for i in range(20_000):
        search.read(i, r.choice(["user", "assistant"]), "x", None)
        stack, n = [search.root], 0
        if i % 100 == 0:
            while stack:
                node = stack.pop()
                n += 1
                stack += node.children
            most = max(most, n)
    search.finish()
    assert most < 300 and len(edits) >= 20_000


def counted(rows, support, longest=5):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    common = {k: v for k, v in f.items() if v >= support}
    out = collections.defaultdict(list)
    for (lang, gram), a in common.items():
        if len(gram) < 2 or any(la == lang and len(b) > len(gram) and c >= a and any(b[i : i + len(gram)] == gram for i in range(len(b))) for (la, b), c in common.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, gram[:k]] * f[lang, gram[k:]]), k) for k in range(1, len(gram)))
        out[lang].append((-score, -a, " ".join(gram).encode(), f[lang, gram[:k]], f[lang, gram[k:]], n[lang]))
    return {(lang, i, g.decode(), -a, left, right, m, -s) for lang, found in out.items() for i, (s, a, g, left, right, m) in enumerate(sorted(found), 1)}


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(30))
    cycle = "c1 c2 c3 c4 c5 c6 " * 4
    texts = [" ".join(r.choice(["The", "of", "and", "é", "x"]) + r.choice(["", "", ",", ".", "\n", "\t"]) for _ in range(r.randrange(60))) for _ in range(120)]
    texts += [f"{passage} tail{i}" for i in range(8)] + [cycle + "z"] * 6 + ["a a a a a a a a a"] * 5 + [None, "", " ,;\n", "w" * 100_000 + " end", "of the " * 4000]
    return [(["en", "en", "de", None][i % 4], t) for i, t in enumerate(texts)] + [("en", texts[0])] * 3


@pytest.mark.parametrize("support", [3, 6])
def test_phrases_equal_counting(spark, corpus, support):
    docs = spark.createDataFrame([(x, t, "s") for x, t in corpus], "lang string, text string, score string").repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, support=support).collect()}
    assert got == counted(corpus, support)


def test_paths_are_compacted(spark, corpus):
    docs = spark.createDataFrame([("en", t) for _, t in corpus if t and t.startswith("p0 ")], "lang string, text string")
    counts = spark.createDataFrame([("en", " ".join(g), len(g), c) for (_, g), c in ((k, v) for k, v in _all(corpus).items() if k[0] == "en" and k[1][0].startswith("p") and k[1][-1].startswith("p"))], "lang string, gram string, size int, f long")
    out = [tuple(r) for r in phrases.paths(counts, support=2).collect()]
    assert out == [("en", " ".join(f"p{i}" for i in range(30)), 30, docs.count())]
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def _all(corpus):
    f = collections.Counter()
    for _, text in corpus:
        if text and text.startswith("p0 "):
            words = text.split()
            for k in (4, 5):
                for i in range(len(words) - k + 1):
                    f["en", tuple(words[i : i + k])] += 1
    return f


def test_own_rows_do_not_end_a_walk(spark):
    r = random.Random(1)
    rows = [(0, [1.0, 0.01 * i, 0.0, 0.5]) for i in range(2000)] + [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(1, 39)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dialogue.F.col("vec_id") == 0, 20).collect()
    assert len(got) in (20, 20 * 2000) and {x["vec_id"] for x in got} <= set(range(1, 39))
    assert all(sum(x["rank"] == k for x in got) == len(got) // 20 for k in range(1, 21))
