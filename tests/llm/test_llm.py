"""The text-preparation operators against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from borelight.llm import chats, decontaminate, fingerprints, mixing, near, personal, tokens, toxicity, urls, wrappers
from borelight.llm.shingles import common, shingle_set

DOCS = "doc_id long, text string, source string, host string, rank int, piece string, component_id long, _k int"


def docs(spark, rows):
    """Rows (doc_id, text, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", 7, 3) for r in rows], DOCS)


def word_soup(seed, n):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 5000, n)]


# 1

def test_distance_is_edit_distance():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 3, r.integers(0, 12)), r.integers(0, 3, r.integers(0, 12))
        d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert decontaminate.distance(a, b, 12) == d[-1][-1]
        assert decontaminate.distance(a, b, 2) == min(d[-1][-1], 3)


def test_passages_are_found(spark):
    item = " ".join(word_soup(1, 30))
    edited = item.replace(item[60], "#", 1).upper().replace(" ", ",\n")
    clean = " ".join(word_soup(2, 300))
    rows = [(1, f"{clean} {item} end", "a"), (2, clean, "a"), (3, edited, "b"), (4, None, None), (5, "", "b"), (None, item, "c"), (1, item, "c"), (6, item[:30], "d")]
    bench = spark.createDataFrame([(9, item), (9, None), (8, ""), (7, "short")], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {r["doc_id"] for r in got} == {1, 3, None}
    assert all(r["item_id"] == 9 for r in got)
    first = next(r for r in got if r["doc_id"] == 1 and r["doc_start"] > 0)
    assert rows[0][1][first["doc_start"] : first["doc_end"]] == item and first["edits"] == 0
    kept = decontaminate.decontaminated(docs(spark, rows), bench)
    assert {r["doc_id"] for r in kept.collect()} == {2, 4, 5, 6} and kept.columns == docs(spark, []).columns
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).count() == 0


def brute_windows(item, text):
    """Item places of windows that lie in `text` with at most EDITS edits: full alignment of each with free ends in the text."""
    a, b = decontaminate.plain(item)[0], decontaminate.plain(text)[0]
    found = []
    for at in range(len(a) - decontaminate.WINDOW + 1):
        row = np.zeros(len(b) + 1, dtype=np.int64)
        for c in a[at : at + decontaminate.WINDOW]:
            new = np.r_[row[0] + 1, np.minimum(row[1:] + 1, row[:-1] + (b != c))]
            row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if row.min() <= decontaminate.EDITS:
            found.append(at)
    return found


def test_passages_inside_reworded_copies():
    r = np.random.default_rng(5)
    counts = set()
    for trial in range(24):
        words = ["".join(r.choice(list("abcdefghijklmnop"), 6)) for _ in range(33)]
        copy = list(words)
        for k in r.choice(33, 3 + trial % 6, replace=False):  # up to 8 words of 6 letters replaced
            copy[k] = "zyxwvu"
        item, text = " ".join(words), " ".join(["before"] * 9 + copy + ["behind"] * 9)
        if trial % 3 == 0:  # single edits too
            text = "".join(c if r.random() > 0.02 else "q" * int(r.integers(0, 3)) for c in text)
        got = decontaminate.regions(text, decontaminate.Index([(1, item)]))
        want = brute_windows(item, text)
        counts.add(bool(want))
        assert all(any(x[3] <= w + 3 and w + decontaminate.WINDOW - 3 <= x[4] for x in got) for w in want), trial
        assert bool(want) or not got
        for _, d0, d1, i0, i1, edits in got:
            a, b = decontaminate.plain(item)[0][i0:i1], decontaminate.plain(text[d0:d1])[0]
            assert edits == decontaminate.distance(a, b, 60)
    assert counts == {True, False} or counts == {True}
    edge = "abcdefghijk" + "lmnopqrstuv".join("0123") + " the rest of the item without any edit"
    item, text = edge[:64], "".join("#" if k in (11, 23, 35) else c for k, c in enumerate(edge[:64]))
    assert len(brute_windows(item, text)) == 1 and decontaminate.regions(text, decontaminate.Index([(1, item)]))


# 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><nav><ul><li><a href=/a>menu {i}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="box">{box}</div><div id=main><h1>Head {i} &amp; more</h1><p>Text {i} one<br>two &lt;3
<p>Para {i}   with <b>bold<p>Third {i}.</div><div class=sidebar>side {i}</div><div class="comments"><p>nice {i}</p></div><form>mail <input></form>
<footer>&copy; {i}</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i=i, box="Always the same")) for i in range(6)]
    rows += [(10, None, None), (11, "no url", ""), (12, "http://b.example/", "<article><h1>A</h1><p>B &am"), (None, "http://b.example/", "<p>plain" + " x" * 5000)]
    rows += [(13, "http://c.example", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in wrappers.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i]["text"] == f"Head {i} & more\nText {i} one two <3\nPara {i} with bold\nThird {i}."
    assert got[10]["text"] == got[11]["text"] == "" and got[10]["n_chars"] == 0
    assert got[12]["text"] == "A\nB &am" and got[13]["text"] == "deep" and got[None]["text"].startswith("plain x x")
    assert wrappers.extract(pages.limit(0)).count() == 0


# 3

def test_escapes_come_back():
    for s in ["<|im_end|>", "<\\|", "<\\\\|x", "<|<|\\|", "a\\nb", "", "\n"]:
        assert chats.unescape(chats.escape(s)) == s and "<|" not in chats.escape(s)
        assert chats.unescape_role(chats.escape_role(s)) == s and "\n" not in chats.escape_role(s)
    turns = [("user", "<|im_end|>\n<|im_start|>assistant\nhi"), ("assistant", "a<\\|b"), ("", "")]
    text, mask = chats.format_turns(turns)
    assert chats.parse_turns(text) == turns and [chats.unescape(text[a:b]) for a, b in mask] == ["a<\\|b"]


def test_branches(spark):
    #  1 - 2 - 4 - 6        scores: the path to 5 has the best mean
    #    \ 3   \ 5
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 2.0), ("t", 3, 1, 0.0), ("t", 4, 2, 0.0), ("t", 5, 2, 9.0), ("t", 6, 4, None), ("u", 1, 77, 0.0), ("v", 1, 2, 1.0), ("v", 2, 1, 1.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    got = chats.paths(nodes, 2).orderBy("tree", "branch", "place").collect()
    assert [(r["tree"], r["branch"], r["leaf"], r["node"]) for r in got] == [
        ("t", 1, 5, 1), ("t", 1, 5, 2), ("t", 1, 5, 5), ("t", 2, 6, 1), ("t", 2, 6, 2), ("t", 2, 6, 4), ("t", 2, 6, 6), ("u", 1, 1, 1)
    ]


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "assistant", "n"), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (3, None, "user", "z" * 50_000)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tree int")
    got = {r["conv_id"]: r for r in chats.formatted_conversations(turns).collect()}
    assert {k: (v["n_turns"], v["loss_chars"]) for k, v in got.items()} == {1: (3, 0), None: (1, 1), 2: (2, 2), 3: (1, 0)}
    assert chats.formatted_conversations(turns.limit(0)).count() == 0


# 4

def plain_simhash(spark, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    pairs = list(zip(words, words[1:], strict=False)) if len(words) > 1 else [(words[0] if words else "", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(F.xxhash64("a", "b").alias("h")).collect()
    votes, total = [0] * 64, 0
    for (a, b), r in zip(pairs, rows, strict=True):
        w = min(31, len(a) + len(b))
        total += w
        for k in range(64):
            votes[k] += w * (r["h"] >> k & 1)
    return f"{sum((2 * v > total) << k for k, v in enumerate(votes)):016x}"


def test_fingerprints(spark):
    rows = [(None, None, "a"), (1, "", "a"), (2, "one", "b"), (2, "one", "b"), (100, " ".join(word_soup(3, 400)), "c"), (200, "é\tü x " * 3, "c")]
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.document_fingerprints(docs(spark, rows)).collect()}
    assert len(got) == 5
    for i, t, _ in rows:
        assert got[i, len(t or "")]["fingerprint"] == plain_simhash(spark, t or "")
    import hashlib

    last, first = rows[-1][1], ""
    edited = last[: len(last) - len(last) // 2] + first[: len(last) // 2]
    assert got[200, len(last)]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert got[100, len(rows[4][1])]["near_next"] <= 1 and got[1, 0]["n_near"] is None
    assert fingerprints.document_fingerprints(docs(spark, [])).count() == 0


def test_pieces_give_the_same_neighbours(spark):
    table = docs(spark, [(int(i), f"text {i}", "a") for i in np.random.default_rng(2).integers(0, 10**12, 300)])
    a, b = (sorted(map(tuple, fingerprints.document_fingerprints(table, piece_rows=n, every=1).collect())) for n in (7, 10**6))
    assert a == b


def test_radius_search_is_whole(spark):
    r = np.random.default_rng(4)
    base = [int(x) for x in r.integers(-(2**63), 2**63 - 1, 40)]
    near_by = [b ^ sum({1 << int(k) for k in r.integers(0, 63, r.integers(0, 6))}) for b in base for _ in range(4)]
    table = spark.createDataFrame([(x,) for x in base + near_by + [None]], "fingerprint long")
    for radius in (0, 2, 3):
        got = {(x["fingerprint"], x["other"]) for x in fingerprints.within_radius(table, table, radius).collect()}
        every = set(base + near_by)
        assert got == {(x, y) for x in every for y in every if ((x ^ y) & (2**64 - 1)).bit_count() <= radius}


# 5

def test_urls(spark):
    rows = ["http://A.Example.NET/en/x?q", "https://net", "ftp://x.example.com/de/#a", "x.org/fr/", None, "", "http://org/fr/1", "http://notnet/", "http://a.org/fr", "s://?a"]
    pages = spark.createDataFrame([(k, u, "z") for k, u in enumerate(rows)] + [(0, rows[0], "z")], "page_id int, url string, host string")
    rules = urls.rule_table(spark, [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "org", "/fr/1x"), ("block", "", "/none")])
    got = urls.judge_urls(pages, rules).orderBy("page_id").collect()
    assert len(got) == 11
    want = {0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("net", "", None, "allow"), 2: ("x.example.com", "/de/", "example.com/de/", "block"),
            3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("org", "/fr/1", "org/fr/", "allow"), 7: ("notnet", "/", None, "allow"),
            8: ("a.org", "/fr", None, "allow"), 9: ("", "", None, "allow")}
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]]
    long = spark.createDataFrame([(1, "http://" + "a." * 3000 + "net/" + "b/" * 3000)], "page_id int, url string")
    assert urls.judge_urls(long, rules).first()["verdict"] == "block"
    assert urls.judge_urls(pages.limit(0), rules).count() == 0 and urls.judge_urls(pages, rules.limit(0)).count() == 11


# 6

def test_chain_learns(spark):
    bad = {"vile", "awful"}
    rows, labels = [], []
    for i in range(600):
        words = [f"c{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}" for x in np.random.default_rng(i).integers(0, 300, 40)]
        toxic = i % 5 == 0
        rows.append((i, " ".join(words + ([sorted(bad)[i % 2]] if toxic else [])), "s"))
        labels.append((i, int(i % 7 > 0), int(toxic)))
    labels += [(None, 1, 1), (5, None, 0)]
    table = docs(spark, [*rows, (None, None, None), (700, "", "s"), (701, "nice vile", "s")])
    chain = toxicity.fit_chain(table, spark.createDataFrame([x for x in labels if x[0] is None or x[0] < 450], "doc_id long, quality int, toxic int"), toxicity.categories())
    got = {r["doc_id"]: r for r in toxicity.scored(table, chain).collect()}
    held_out = [i for i in range(450, 600)]
    assert np.mean([got[i]["rejected"] == (i % 5 == 0) for i in held_out]) > 0.97
    assert got[701]["rejected"] and not got[700]["rejected"] and not got[None]["rejected"]
    kept = toxicity.accepted(table, chain)
    assert kept.columns == table.columns and kept.count() == sum(not r["rejected"] for r in got.values())
    assert toxicity.scored(table.limit(0), chain).count() == 0
    nothing = toxicity.fit_chain(table, spark.createDataFrame([], "doc_id long, quality int, toxic int"), toxicity.categories())
    assert not any(r["rejected"] for r in toxicity.scored(table.limit(5), nothing).collect())


# 7

def test_superminhash_estimates_likeness():
    r = np.random.default_rng(5)
    for n, same in ((300, 240), (40, 30), (3000, 2700)):
        x = r.integers(0, 2**63, 2 * n - same).astype(np.uint64)
        a, b = np.unique(x[:n]), np.unique(x[n - same :])
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near.superminhash(a) == near.superminhash(b)).mean() - j) < 0.13
        assert common(a, b) == len(np.intersect1d(a, b))
    one = near.superminhash(np.array([7], dtype=np.uint64))
    assert sorted(int(v >> np.uint64(48)) for v in one) == list(range(near.SLOTS))


def brute_components(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t, _ in rows if i is not None}
    at = {i: i for i in sets}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = common(sets[a], sets[b])
            if c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_components_are_those_of_all_pairs(spark, size):
    r = np.random.default_rng(6)
    rows = [(900, None, "a"), (901, "", "a"), (902, " \t\n", "a"), (903, "One", "a"), (904, "one", "a"), (905, "a B", "a"), (906, "A b", "a"), (None, "A b", "a"), (None, "alone here", "a")]
    for g in range(3):
        base = word_soup(g, 120)
        for i in range(40):
            words = list(base)
            for k in r.integers(0, 120, r.integers(0, 14)):
                words[k] = f"v{r.integers(0, 40)}"
            rows.append((g * 100 + i, " ".join(words), "s"))
    rows.append((1000, " ".join(word_soup(50, 30_000)), "s"))
    got = near.near_duplicates(docs(spark, rows), size, 80).collect()
    want = brute_components(rows, size, 80)
    assert len(got) == len(rows)
    for x in got:
        if x["doc_id"] is not None:
            assert (x["n_shingles"], x["component_id"]) == want[x["doc_id"]] and x["kept"] == (x["doc_id"] == x["component_id"])
    assert sorted((x["component_id"] or -1, x["kept"]) for x in got if x["doc_id"] is None) == [(-1, True), (905, False)]
    kept = near.deduplicated(docs(spark, rows + rows[3:4]), size, 80)
    assert sorted(x["doc_id"] for x in kept.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert near.near_duplicates(docs(spark, []), size, 80).count() == 0


# 8

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and personal.luhn(d)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
]


def test_base_spans_are_those_of_the_patterns():
    r = np.random.default_rng(7)
    bits = ["a", "@", ".", "1", "25", "300", " ", "-", "+", "(", ")", "b.c", "x@y.z", "4111111111111111", "_", "é", "10.0.0.1", "+1 (843) 555-7672"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.integers(0, 14)))
        want = [(k, *m.span()) for k, p, ok in BASE for m in re.finditer(p, text) if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
        assert personal.base_spans(text) == want, text


def test_added_spans(spark):
    r = np.random.default_rng(8)
    phone = lambda: f"+1 ({r.integers(100, 999)}) 555-{r.integers(1000, 9999)}"
    train = [(i, f"call {phone()} or {r.integers(0, 255)}.1.2.{r.integers(0, 255)} now a.b{i}@mail.example.com", "s") for i in range(150)]
    text = "ring +1 (843) 555-7672 170.106.47.218 then"
    rows = [*train, (500, text, "s"), (501, None, "s"), (502, "", "s"), (None, "1" * 30_000 + "@" * 100, "s"), (503, "token = 1a6c4f8b", "s")]
    got = {x["doc_id"]: x for x in personal.personal_data(docs(spark, rows)).collect()}
    assert got[500]["n_phone"] == 0 and got[500]["spans"] == "ip:23:37,phone:5:22"
    assert got[501]["spans"] == got[502]["spans"] == got[503]["spans"] == "" and got[0]["n_email"] == 1
    assert personal.personal_data(docs(spark, [])).count() == 0


# 9

def test_schedule_stays_within_a_block():
    for weights, period in (({"a": 1, "b": 1}, 10), ({"a": 5, "b": 3, "c": 1, "d": 0.5}, 97), ({k: k + 1 for k in range(30)}, 500)):
        shares = mixing.whole_shares(weights, period)
        rows = mixing.schedule(shares)
        assert sum(shares.values()) == period and [x[4] for x in rows] == list(range(period))
        done = dict.fromkeys(shares, 0)
        for s, j, release, due, slot in rows:
            assert j == done[s] and release <= slot < due
            done[s] += 1
            assert all(abs(done[x] - shares[x] * (slot + 1) / period) < 1 for x in shares)


def test_mix(spark):
    rows = [(i, None, "big" if i % 3 else "small") for i in range(1, 400)] + [(None, "x", None), (None, "y", None), (5, None, "small"), (5, None, "small")]
    got = mixing.mix(docs(spark, rows), {"big": 3, "small": 1, None: 1}, block_rows=4, period=64).collect()
    assert len(got) == len(rows) and len({x["mix_position"] for x in got}) == len(rows)
    big = [x for x in got if x["source"] == "big"]
    assert max(x["mix_block"] for x in big) == (len(big) - 1) // 4 and all(x["mix_release"] <= x["mix_slot"] < x["mix_deadline"] for x in got)
    assert mixing.mix(docs(spark, [])).count() == 0
    with pytest.raises(Exception, match="no weight"):
        mixing.mix(docs(spark, rows), {"big": 1}).collect()


def test_mix_keeps_to_the_given_weights(spark):
    weights = {"hot": 0.2} | {f"s{k}": 0.8 / 19 for k in range(19)}
    weights["s3"] *= 1.37
    rows = [(i, None, s) for i, s in enumerate(s for s in weights for _ in range(round(weights[s] * 24000)))]
    got = mixing.mix(docs(spark, rows), weights, block_rows=2, period=64).select("source", "mix_slot", "mix_block").distinct().collect()
    left = {s: sum(r["source"] == s for r in got) for s in weights}
    done, total, slots = dict.fromkeys(weights, 0), sum(weights.values()), set()
    for r in sorted(got, key=lambda r: r["mix_slot"]):
        assert r["mix_block"] == done[r["source"]] and r["mix_slot"] not in slots
        slots.add(r["mix_slot"])
        done[r["source"]] += 1
        assert all(abs(done[s] - w / total * (r["mix_slot"] + 1)) < 1 + 1e-6 for s, w in weights.items() if done[s] < left[s])
    assert done == left and len(slots) > 10000  # more than 150 of the old periods


def test_mix_of_many_sources(spark):
    rows = [(i, None, f"host{i % 5000}") for i in range(6000)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len({r["mix_position"] for r in got}) == 6000 and {r["doc_id"] for r in got} == set(range(6000))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)


# 10

def test_blocks_come_back():
    r = np.random.default_rng(9)
    for n in (0, 1, 5, 4096, 70_001, 700_000):
        ids = (r.exponential(300, n).astype(np.uint32) * 7) % 50_000
        table = tokens.Table(tokens.frequencies(np.bincount(ids, minlength=50_257)))
        block = tokens.encode_block(ids, table)
        assert (tokens.decode_block(block, table) == ids).all()
        if n == 700_000:
            assert (np.concatenate([tokens.decode_rows(block, table, 0, 1), tokens.decode_rows(block, table, 1)]) == ids).all()
            assert len(block) < 2 * n
            with pytest.raises(ValueError):
                tokens.decode_block(block[:-1] + bytes([block[-1] ^ 1]), table)
    only = np.full(1000, 3, dtype=np.uint32)
    table = tokens.Table(tokens.frequencies(np.bincount(only)))
    assert (tokens.decode_block(tokens.encode_block(only, table), table) == only).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    rows = [(3, "Hello there\nyou  two", "a"), (None, None, "a"), (1, "", "a"), (2, "é 漢字 don't" * 50, "b"), (2, "again", "b"), (9, "x" * 20_000, "c"), (5, "a <|endoftext|> b<|endoftext|>\n", "c"), (4, " ".join(word_soup(1, 3000)), "c")]
    got = tokens.encoded(docs(spark, rows), path).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    want = []
    for i, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((-1 if i is None else i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == sorted(want)
    assert [x["doc_id"] for x in got] == [None, 1, 2, 2, 3, 4, 5, 9]
    assert [x["start"] for x in got] == np.cumsum([0, *(x["n_tokens"] for x in got)])[:-1].tolist()
    assert tokens.encoded(docs(spark, []), path).count() == 0


# columns of the caller, repeated ids, deep pages

CLASH = "doc_id long, text string, source string, url string, _k int, _h int, _i string, _b int, _rank int, _salt int, _best string, _row int, _whole int, _number int, _ties int, _s int, n int"


def test_callers_columns_come_back_as_they_were(spark):
    texts = [" ".join(word_soup(k, 40)) for k in range(6)]
    rows = [(k, texts[k % 4], "ab"[k % 2], f"http://h{k}.net/p/", k, -k, f"i{k}", 3, 4, 5, "b", 6, 7, 8, 9, 10, 11) for k in range(8)]
    df = spark.createDataFrame(rows, CLASH)
    mixed = mixing.mix(df)
    assert sorted(tuple(r)[: len(df.columns)] for r in mixed.collect()) == rows and mixed.columns[: len(df.columns)] == df.columns
    kept = near.deduplicated(df)
    assert sorted(map(tuple, kept.collect())) == rows[:4] and kept.columns == df.columns
    judged = urls.judge_urls(df, urls.rule_table(spark, [("block", "net", "/")]))
    assert sorted(tuple(r)[: len(df.columns)] for r in judged.collect()) == rows and judged.where("verdict = 'block'").count() == 8


def test_repeated_ids_with_different_texts_lose_no_link(spark):
    long = [f"w{k}" for k in range(11)]
    rows = [(1, "aaa bbb ccc ddd"), (1, " ".join(long)), (2, " ".join([*long, "w11"])), (3, "quite another text here"), (3, ""), (None, "aaa bbb ccc ddd")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 3), (None, 1)} and len(got) == 6


def test_deep_pages_keep_what_follows(spark):
    menu = "<nav><ul>" + "".join(f"<li><a href='/{k}'>menu {k}</a></li>" for k in range(9)) + "</ul></nav>"
    deep = f"<html><body><article><h1>T</h1>{'<div>' * 250}{menu}<p>inner one</p><p>inner two</p>{'</div>' * 250}<p>AFTER</p></article><footer>foot</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://a.org/x", deep)], "page_id long, url string, html string")
    assert wrappers.extract(pages).first()["text"] == "T\ninner one\ninner two\nAFTER"


# registered queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not there")
def test_queries(spark):
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    for n in names:
        assert entry.queries()[n](spark, FOLDER).count() > 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not there")
def test_pipeline_keeps_the_mixed_order(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    assert 0 < out.count() < 200 and out.select("doc_id").distinct().count() == out.count()


def test_simple_words_go_to_the_model(monkeypatch):
    """The ids of a whole call, whatever the text; plain words need no call of the whole tokenizer."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from borelight.llm import tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    signs = [*"aZé\u00c0ßŁ\u024fǃ0\u0037.,!?<|>_-#`~[]\\{}^$&*() ", "'", "\u00aa", "²", "×", "÷", "\u0250", "ж", "日", "\u00ad", "\u00a0", "\x7f", "\x01", "\t", "\n", " ", " ", "the", "'s", "<|endoftext|>"]
    rng = np.random.default_rng(23)
    texts = ["", "don't l'été x² 3.14", "a<|endoftext|>b <|endoftext|>, <|endoftext", *["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(4000)]]
    t = tokens.Ids(path)
    ids, bounds = t.encode(pa.array(texts))
    want = [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    assert all(t.word(bytes([b]).decode("latin-1")) == np.array(t.tokenizer.encode(chr(b), add_special_tokens=False).ids, "<u4").tobytes() for b in range(33, 256) if tokens.SIMPLE.fullmatch(chr(b)))

    def called(texts):
        assert not texts

    monkeypatch.setattr(t, "ids", lambda texts: called(texts) or [])
    assert t.encode(pa.array(["unheard-of wörds, 1234 of them!"]))[1].tolist()[0] == 0


def test_pipeline_stages_hand_small_batches_to_python(spark):
    import pyarrow as pa

    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(corpus_pipeline.BATCH)
    try:
        for given, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("300", 300)):
            spark.conf.set(corpus_pipeline.BATCH, given)
            stage = corpus_pipeline.in_batches(lambda s, docs, folder: docs.mapInArrow(sizes, "n long"))
            got = [r["n"] for r in stage(spark, spark.range(0, 9000, 1, 1), "").collect()]
            assert sum(got) == 9000 and max(got) <= most
    finally:
        spark.conf.set(corpus_pipeline.BATCH, before)
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)


def test_pipeline_stages_hand_few_bytes_to_python(spark):
    import pyarrow as pa

    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    before = {c: spark.conf.get(c) for c in (corpus_pipeline.BATCH, "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        stage = corpus_pipeline.in_batches(lambda s, docs, folder: docs.mapInArrow(sizes, "n long, size long"))
        got = stage(spark, spark.range(0, 2000, 1, 1).selectExpr("id", "repeat('long text ', 500) AS text"), "").collect()
        assert sum(r["n"] for r in got) == 2000 and max(r["size"] for r in got) <= 2 << 20  # 10 MB in all
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_small_batches_are_gathered():
    import pyarrow as pa

    from borelight.llm import units

    schema = pa.schema([("place", pa.int64()), ("text", pa.string())])
    batches = [pa.RecordBatch.from_pydict({"place": [k], "text": [x * (1 << 20) if x else x]}, schema=schema) for k, x in enumerate(["a", None, "b", "", "c", "d", "e", "f"])]
    got = list(units.gathered(iter(batches)))
    assert len(got) == 2 and got[0].nbytes >= units.SLICE_BYTES and pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches(batches).to_pydict()
    assert list(units.gathered(iter([]))) == []


def test_side_tables_start_no_python_workers(spark, tmp_path):
    docs = spark.range(8).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'a', 'b') AS source")
    mixed = mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
    tokens.write_tokens(docs, str(tmp_path), pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    read = tokens.read_tokens(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in mixed + read and "LocalRelation" in mixed and "LocalRelation" in read  # none is an RDD of pickled rows
