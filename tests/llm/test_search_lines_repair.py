"""Ranked search, line removal and conversation repair against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from imputeflow.llm import lexical, line_runs, repair
from imputeflow.llm.shared import SLICE_BYTES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- ranked search -------------------------------------------------------------------

def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_search(docs, items, k):
    held = [(i, t) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, n_terms = len(held), sum(len(t) for _, t in held)
    df = Counter(w for _, t in held for w in set(t))
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, query in asked.items():
        found = []
        for place, (doc, t) in enumerate(held):
            tf, m = Counter(t), 75 + 25 * len(t) * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                        * (1000000000 * tf[w] // (1000 * tf[w] + 12 * m)) for w, q in query.items() if tf[w])
            if score > 0:
                found.append((-score, doc is None, doc or 0, place, doc, score))
        out += [(item, r + 1, f[4], f[5]) for r, f in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def searched(spark, docs, items, k, **options):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, row int")
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, rank string")
    return sorted(map(tuple, lexical.search(d, q, k, **options).collect()), key=repr)


def zipf_docs(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "ÉTÉ"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, r.choice([" ", ", ", "\n"]).join(r.choices(words, weights, k=r.randint(1, 60)))) for i in range(n)]


def test_search_equals_brute_force(spark):
    docs = zipf_docs(400)
    docs += [(7, docs[8][1]), (None, docs[9][1]), (None, docs[9][1]), (900, None), (901, ""), (902, " .,;"), (903, "w0")]
    items = [(i, d[1]) for i, d in enumerate(zipf_docs(25, 5))]
    items += [(100, None), (101, "nothing-like-it"), (102, "W0 w0 w0 W1"), (None, "w250 w251"), (3, "w299")]
    assert searched(spark, docs, items, 5) == brute_search(docs, items, 5)


def test_search_in_blocks_and_with_few_documents(spark):
    docs, items = zipf_docs(30), [(i, d[1]) for i, d in enumerate(zipf_docs(12, 8))]
    assert searched(spark, docs, items, 20, block_terms=60) == brute_search(docs, items, 20)


def test_search_of_empty_tables_and_a_very_long_text(spark):
    assert searched(spark, [], [(1, "a")], 3) == []
    assert searched(spark, [(1, "a b")], [], 3) == []
    long = "filler words " * (SLICE_BYTES // 12)
    docs = [(1, long + "needle"), (2, "needle"), (3, "other"), (4, long)]
    assert searched(spark, docs, [(1, "needle filler")], 3) == brute_search(docs, [(1, "needle filler")], 3)


def test_accumulators_stop_before_common_words(spark, monkeypatch):
    """Common words make no accumulators once a rare one has filled the best places."""
    seen = []
    real = lexical._best
    monkeypatch.setattr(lexical, "_best", lambda acc, k: seen.append(acc.count()) or real(acc, k))
    docs = [(i, "common " * 3 + ("rare words here" if i < 5 else "plain")) for i in range(200)]
    assert searched(spark, docs, [(1, "rare common")], 2) == brute_search(docs, [(1, "rare common")], 2)
    assert seen[0] == 5 and max(seen) == 5


# ---- lines ---------------------------------------------------------------------------

def brute_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)

    first = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                rank = (doc is None, doc or 0)
                first[k] = min(first.get(k, rank), rank)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if first.get(key(x), (doc is None, doc or 0)) == (doc is None, doc or 0)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def deduped(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 5, "n", 3) for d, t in rows],
                               "doc_id long, text string, place int, hot string, batch int")
    got = line_runs.drop_repeated_lines(df, **options)
    assert got.columns == ["doc_id", "text", "place", "hot", "batch", "kept_text", "n_lines", "n_dropped"]
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr)


def line_rows(n, seed=1):
    r = random.Random(seed)
    pool = [f"shared line number {i}" for i in range(40)]
    rows = []
    for i in range(n):
        lines = [r.choice([r.choice(pool), r.choice(pool).upper(), f"\t {r.choice(pool)} \r", f"own line {i} of {r.random()}",
                           "short", "", "a common footer line"]) for _ in range(r.randint(1, 12))]
        rows.append((i, "\n".join(lines)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("batches,fanout", [(2, 2), (6, 3), (7, 2)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rows = line_rows(200)
    rows += [(None, "a common footer line\nonly of nobody\nonly of nobody"), (None, "only of nobody\nshared line number 3"),
             (500, None), (501, ""), (502, "\n\n"), (3, "a second text of three\nshared line number 1"), rows[0], rows[0],
             (503, "ÄÖÜ straße lang\nin between"), (504, "äöü straße lang\nÄÖÜ Straße LANG"), (505, "\xa0nine chars")]
    assert deduped(spark, rows, batches=batches, fanout=fanout) == brute_lines(rows)


def test_lines_of_few_ids_hot_lines_and_long_texts(spark):
    rows = [(1, "the very same line\n" * 3000), (2, "the very same line\n" * 2000 + "tail of the second"),
            (2, "the very same line"), (3, "x" * (SLICE_BYTES + 10)), (4, "y\n" + "x" * (SLICE_BYTES + 10))]
    assert deduped(spark, rows, batches=4) == brute_lines(rows)
    assert deduped(spark, [(None, "one line of text"), (None, "one line of text")]) == brute_lines(
        [(None, "one line of text"), (None, "one line of text")])
    assert deduped(spark, []) == []


def test_runs_are_merged_by_levels_and_deleted(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    for b in range(5):
        docs = spark.createDataFrame([(b, i, f"line {i % 7 + b} of many words") for i in range(b * 10, b * 10 + 10)],
                                     "batch int, doc_id long, text string")
        runs.add(line_runs.lines_of(docs).drop("batch")).count()
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [runs._run(t).count() for level in runs.levels for t, _ in level]
    assert sum(held) == 11  # each line is held once
    names = [t for level in runs.levels for t, _ in level]
    runs.close()
    assert not any(spark.catalog.tableExists(t) for t in names)


# ---- repair --------------------------------------------------------------------------

INKED = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows, every):
    out = []
    for conv in every:
        own = sorted((r[1:] for r in rows if r[0] == conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            ink = INKED.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen
                          else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        after = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        name = {"u": "user", "a": "assistant"}
        memo = {}

        def best(i, state, inserts):
            """Least (cost, audit, repaired lines) from row i on, `inserts` of the last edits being insertions."""
            at = (i, state, inserts)
            if at in memo:
                return memo[at]
            options = []
            if i == len(own) and state in ("", "a"):
                options.append((0, "", ()))
            if inserts < 4:
                for role in "ua":
                    if (state, role) in after:
                        c, a, lines = best(i, after[state, role], inserts + 1)
                        options.append((c + 5, "I" + a, (name[role] + ":", *lines)))
            if i < len(own):
                _, role, text = own[i]
                c, a, lines = best(i + 1, state, 0)
                options.append((c + 2, "D" + a, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 if faults[i] == "truncated" else 0
                    if (state, role[:1]) in after:
                        c, a, lines = best(i + 1, after[state, role[:1]], 0)
                        options.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                    for given in "ua":
                        if (state, given) in after:
                            c, a, lines = best(i + 1, after[state, given], 0)
                            options.append((c + 1 + more, "R" + a, (f"{name[given]}:{text}", *lines)))
            memo[at] = min(options) if options else (10**9, "", ())
            return memo[at]

        cost, audit, lines = best(0, "", 0)
        kinds = Counter(faults)
        out.append((conv, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal,
                    max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(n, seed=2):
    r = random.Random(seed)
    texts = ["Fine.", "Well done!", "cut off", " \t", "", "So?  ", "Fine.", "a \x0b", None, "ok.\xa0"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "User", None, "ugly", "analyst"]
    rows = []
    for conv in range(n):
        for t in range(r.randint(1, 9)):
            turn = r.choice([t, t, t, t + 3, None, -t])
            role = r.choice(roles) if r.random() < 0.4 else ["user", "assistant"][t % 2]
            rows.append((conv, turn, role, r.choice(texts) if r.random() < 0.6 else f"Text {r.random()}."))
    return rows


def report(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows],
                               "conv_id long, turn long, role string, text string, cost int, known string")
    got = repair.repair_report(repair.damaged(df), **options)
    return sorted(map(tuple, got.select("conv_id", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit",
                                        "repaired_sha256").collect()), key=repr)


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_repair_equals_brute_force(spark, chunk):
    rows = conversations(250)
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes."), (2**60 + 1, 2**60, "user", "Big."),
             (2**60 + 1, 2**60 + 1, "assistant", "Bigger."), *rows[:40]]
    rows += [(700, None, None, None), (701, 1, "user", "Once."), (701, 1, "user", "Twice."), (701, 1, "assistant", "Once.")]
    every = {r[0] for r in rows}
    assert report(spark, rows, chunk=chunk) == brute_repair(brute_damage(rows), every)


def test_repair_of_a_giant_conversation_and_of_an_empty_table(spark):
    rows = [(5, t, ["user", "assistant"][t % 2] if t % 7 else "user", f"Line {t}." if t % 11 else "cut") for t in range(30000)]
    got = report(spark, rows, chunk=1000)
    assert got == report(spark, rows) and len(got) == 1 and len(got[0][7]) >= 28000
    assert report(spark, []) == []


def test_long_texts_pass_through_the_repair(spark):
    long = "word " * (SLICE_BYTES // 5) + "end."
    rows = [(1, 1, "user", long), (1, 2, "assistant", "Yes."), (1, 3, "user", long)]
    assert report(spark, rows) == brute_repair(brute_damage(rows), {1})


def test_repaired_turns_are_the_audit_and_the_digest(spark):
    rows = conversations(40, seed=9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = {}
    for r in repair.repaired_turns(repair.damaged(df), chunk=3).orderBy("conv_id", "n").collect():
        edits.setdefault(r.conv_id, []).append(r)
    for conv, *_, audit, digest in report(spark, rows):
        own = edits.get(conv, [])
        assert "".join(r.edit for r in own) == audit
        lines = [f"{r.role}:{r.text}" for r in own if r.edit != "D"]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digest


def test_least_audit_among_all_edit_sequences():
    """The carried costs against every sequence of edits of up to three rows."""
    rows = [(i, f) for i in ("s", "u", "a", "x") for f in (0, 1, 2)]
    r = random.Random(4)
    for _ in range(60):
        own = [r.choice(rows) for _ in range(r.randint(0, 3))]
        best = None
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(own) + 1):
            for edits in itertools.product("DKuUa", repeat=len(own)):
                if "U" in edits:
                    continue
                cost, audit, roles = 0, "", ""
                for (initial, fault), gap, e in zip(own, gaps, edits):
                    cost, audit, roles = cost + 5 * len(gap), audit + "I" * len(gap), roles + gap
                    if e == "D":
                        cost, audit = cost + 2, audit + "D"
                        continue
                    if fault == 2:
                        cost = 10**6
                    cost += (5 if fault == 1 else 0) + (e != "K")
                    audit, roles = audit + ("K" if e == "K" else "R"), roles + (initial if e == "K" else e)
                cost, audit, roles = cost + 5 * len(gaps[-1]), audit + "I" * len(gaps[-1]), roles + gaps[-1]
                if re.fullmatch(r"(s?(ua)+)?", roles) and cost < 10**6:
                    best = min(best or (cost, audit), (cost, audit))
        rest, bytes_ = repair.AT_END, []
        for initial, fault in reversed(own):
            rest, byte = repair.step(rest, initial if initial in "sua" else "", fault)
            bytes_.append(byte)
        walk = repair._Forward("1", {})
        walk.more(bytes(bytes_))
        audit = "".join(e for initial, _ in own for e, _ in walk.edited(initial)) + "".join(e for e, _ in walk.end())
        assert (rest[repair.START], audit) == best
