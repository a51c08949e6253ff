"""Operators of the training-data folder against brute force, with nulls, empty texts, ties and clashing columns."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilgrid.llm import blockknn, bpe, components, imatch, langid, licenses, neardup, packing, queries, roles, substrings, toxicity

RANKS = queries.file_bytes(queries.RANKS)
TOKENIZER = queries.file_bytes(queries.TOKENIZER).decode()
ODD = ["", None, " ", "a", "x" * 3000, "é日🎉 " * 3, "word", "\n\n\t", "<|endoftext|> don't 12 ²½ x__y  z"]
DOC = "doc_id long, text string, lang string, source string, n_chars long, terms_ string, cls long, row_ long, place int, seed long"


def docs(spark, texts, lang=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, lang[i] if lang else None, "s", 0, "?", -1, -1, -1, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_bpe_equals_library_and_round_trips(spark):
    rng = random.Random(1)
    texts = ODD + [prose(rng, 50) for _ in range(10)] + ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(20)]
    ids = bpe.encode(docs(spark, texts), "text", ["doc_id"], RANKS, public_tokenizers.PATTERN, public_tokenizers.PATTERN)
    rows = {r["doc_id"]: r for r in bpe.decode(ids, "token_ids", ["doc_id", "token_ids"], RANKS).collect()}
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for i, t in enumerate(texts):
        assert np.frombuffer(rows[i]["token_ids"], "<u4").tolist() == own.encode_ordinary(t or "")
        assert bytes(rows[i]["decoded"]) == (t or "").encode()


def test_utf8_machine_keeps_all_bytes():
    raw = "aé日🎉".encode() * 3 + b"\xff\xe6\x97" + "é".encode() + b"\xf0\x9f"
    for step in range(1, 9):
        machine = bpe.Utf8()
        parts = [machine.feed(raw[i : i + step]) for i in range(0, len(raw), step)] + [machine.finish()]
        assert b"".join(parts) == raw
    machine = bpe.Utf8()
    assert machine.feed("é".encode()[:1]) == b"" and machine.feed("é".encode()[1:]) == "é".encode()


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float).tolist()
    x[7] = x[9] = x[11] = x[0]
    rows = [(i, v, "c") for i, v in enumerate(x)] + [(400, None, "c"), (401, [0.0] * 8, "c"), (402, [float("nan")] * 8, "c"), (403, [None] * 8, "c"), (None, x[1], "c"), (7, x[7], "c"), (404, [1.0], "c")]
    usable = blockknn.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string"), "vec_id", "embedding")
    got = blockknn.nearest(usable.where("id % 20 = 0"), usable, 5, query_block=4, candidate_block=64).collect()
    m = np.array(x)
    for q in range(0, 300, 20):
        s = blockknn.products(np.repeat(m[q : q + 1], 300, axis=0), m)
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[1] for r in mine] == want and [r[2] for r in mine] == [s[i] for i in want]


def reached(sets, links):
    root = list(range(len(sets)))
    for a, b in links * len(sets):
        root[a] = root[b] = min(root[a], root[b])
    return root


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts = ODD + [prose(rng, 80) for _ in range(5)]
    for _ in range(40):  # a group whose members differ by up to a third
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(120)] = "edit"
        texts.append(" ".join(words))
    texts += [texts[-1], "Word", texts[-1].upper()]

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = reached(sets, links)
    for r in neardup.link(docs(spark, texts), "doc_id", "text").collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_components_of_a_chain(spark):
    found = components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(1, 51)}


def test_license_places(spark):
    texts = ODD + ["The MIT-License, CC BY (cc by)", "gnu general public license gnu general public licence", "Licensed under CC BY-NC 4.0.",
                   "Permission is hereby granted, free of all charge, to any person obtaining a copy of this software and the associated documentation files"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts), "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(k for k, _ in at)) if at else (None, None))
    assert got[len(ODD) + 2]["labels"] == "cc-by,cc-by-nc" and got[len(ODD) + 3]["labels"] == "mit"


def test_license_spans_are_verified(spark):
    bsd = next(t for t, v in licenses.TEMPLATES.items() if v == "bsd").split()
    texts = ["bsd 3 clause bsd 3 clause", "permission is hereby " * 14, " ".join(bsd[10:] + bsd[:10]), " ".join(bsd[:9] + ["own"] + bsd[9:]), "BSD-3 Clause,\n license",
             "bsd 3 clause license " * 20_000, "x " * 300_000 + " ".join(bsd), " ".join(bsd[:6]) + " z" * 40 + " " + " ".join(bsd[6:12])]
    got = [r["labels"] for r in licenses.scan(docs(spark, texts), "doc_id", "text").orderBy("doc_id").collect()]
    assert got == ["", "", "", "bsd", "bsd", "bsd", "bsd", ""]


def test_longest_span_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        hits = sorted({(rng.randrange(30), rng.randrange(8)) for _ in range(rng.randrange(1, 25))})
        best = {}
        for i, (p, a) in enumerate(hits):
            best[i] = 1 + max([best[j] for j, (q, b) in enumerate(hits[:i]) if q < p and b < a and abs(p - a - q + b) <= 3], default=0)
        assert licenses.longest_span([{"place": p, "at": a} for p, a in hits], 3, 8)[0] == max(best.values())


def test_languages(spark):
    rng = random.Random(4)
    parts = {"xx": ["kor", "tav", "mel", "zin"], "yy": ["ouè", "ché", "rea", "ent"]}
    lang = [rng.choice(["xx", "yy"]) for _ in range(300)]
    texts = ["".join(rng.choice(parts[x]) + rng.choice(["", " "]) for _ in range(40)) for x in lang]
    texts[0], texts[1], texts[2] = None, "12 34 !!", ""
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, texts, lang), "doc_id", "text", "lang", ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and not got[0]["accepted"]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in range(3, 300)]) > 0.98
    assert all(r["lang_pred"] == "und" for r in langid.identify(docs(spark, ["abc"]), "doc_id", "text", "lang", ["doc_id"]).collect())


def test_toxic_words_behind_disguise(spark):
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(400):
        words = [rng.choice(["lamer", "sona", "tide", "moral", "grin", "stone", "idle"]) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = "idiotic"
        texts.append(" ".join(words))
        toxic.append(int(i % 4 == 0))
    hidden = ["sona 1d10tic tide", "grin i d i o t i c stone", "idiooootic", "stone tide", None, ""]
    frame = docs(spark, texts + hidden)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame, labels, "doc_id", "text", ["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(toxic[i]) for i in range(400))
    assert [got[400 + i] >= 0.5 for i in range(6)] == [True, True, True, False, False, False]


def test_packing_covers_every_token_once(spark):
    rng = random.Random(6)
    texts = ODD + [prose(rng, rng.randrange(1, 1500)) for _ in range(40)]
    own = Tokenizer.from_file(queries.TOKENIZER)  # which matches the file's added tokens first
    ids = [np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    rows = packing.pack(docs(spark, texts), "doc_id", "text", TOKENIZER, public_tokenizers.PATTERN, shard_tokens=4096).collect()
    seen = [0] * len(texts)
    windows = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        d = r["doc_id"]
        assert r["start"] == seen[d] and r["doc_tokens"] == len(ids[d])
        seen[d] += r["length"]
        assert zlib.crc32(ids[d][r["start"] : seen[d]].tobytes()) == r["ids_crc32"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == [len(x) for x in ids]
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def cheapest(given):
    """Least cost over all labels, merges and insertions, by search."""
    def search(i, state):
        if i == len(given):
            return 0.0 if state in roles.FINAL else roles.INSERT
        best = float("inf")
        for role in (1, 2, 3):
            label = 0.0 if role == given[i] else roles.RELABEL if given[i] else roles.UNKNOWN
            if role == state:
                best = min(best, label + roles.MERGE + search(i + 1, role))
            for n in range(3):
                for path in itertools.product((1, 2, 3), repeat=n):
                    line = [state, *path, role]
                    if all(b in roles.FOLLOW[a] for a, b in zip(line, line[1:])):
                        best = min(best, label + roles.INSERT * n + search(i + 1, role))
        return best

    return search(0, 0)


def test_role_repair_is_cheapest_and_legal(spark):
    rng = random.Random(7)
    names = ["user", "assistant", "system", "tool", None]
    chats = [[rng.choice(names) for _ in range(rng.randrange(1, 6))] for _ in range(30)] + [["user", "user", "assistant"] * 60]
    rows = [(c, t, role, None if t % 5 == 4 else f"t{t}", "x") for c, chat in enumerate(chats) for t, role in enumerate(chat)]
    got = roles.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")).collect()
    for c, chat in enumerate(chats):
        mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["turn"])
        assert [r["role_given"] for r in mine] == chat
        if len(chat) < 10:
            assert sum(r["cost"] for r in mine) == pytest.approx(cheapest([roles.number_of(r) for r in chat]))
        else:
            assert sum(r["cost"] for r in mine) == pytest.approx(60 * roles.MERGE)
        whole = "".join(r["rendered"] for r in mine)
        order = [roles.ROLES.index(x) for x in re.findall(r"<\|(system|user|assistant)\|>", whole)]
        assert all(b in roles.FOLLOW[a] for a, b in zip([0, *order], order)) and order[-1] in roles.FINAL
        assert whole.count(roles.END) == len(order) and whole.endswith(roles.END)


def test_repeated_passages_are_found_and_cut(spark):
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    fuzzy = list(passage)
    fuzzy[20], fuzzy[45] = "other", "words here"
    texts = [prose(rng, 60, 10**6) for _ in range(12)] + ODD
    for i, p in ((2, passage), (5, passage), (8, fuzzy)):
        texts[i] = f"{texts[i]} {' '.join(p)} {prose(rng, 30, 10**6)}"
    frame = docs(spark, texts)
    found = {r["doc_id"]: r for r in substrings.repeats(frame, "doc_id", "text").collect()}
    assert set(found) == {5, 8} and all(r["source_ids"] == [2] for r in found.values())
    assert (found[5]["from_word"], found[5]["to_word"], found[5]["equal_words"]) == (60, 130, 70)
    left = {r["doc_id"]: r["text"] for r in substrings.remove(frame, "doc_id", "text", spark.createDataFrame(list(found.values()))).collect()}
    assert left[5].split() == texts[5].split()[:60] + texts[5].split()[130:] and "p30" not in left[8].split()
    assert all(left[i] == texts[i] for i in range(len(texts)) if i not in found)


def test_fingerprints(spark):
    rng = random.Random(9)
    texts = [prose(rng, 80, 300) for _ in range(30)] + ODD
    texts[4] = texts[3]
    got = {r["doc_id"]: r for r in imatch.fingerprint_pairs(docs(spark, texts), "doc_id", "text").collect()}
    assert got[3]["fingerprint"] == got[4]["fingerprint"] and got[3]["near_next"] == 1.0
    assert all(r["n_chars"] == len(texts[i] or "") and 0 <= r["near_edited"] <= 1 for i, r in got.items()) and len(got) == len(texts)


def test_empty_tables(spark):
    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    frames = [
        bpe.encode(none, "text", ["doc_id"], RANKS, public_tokenizers.PATTERN), neardup.link(none, "doc_id", "text"), licenses.scan(none, "doc_id", "text"),
        langid.identify(none, "doc_id", "text", "lang", ["doc_id"]), toxicity.score(none, labels, "doc_id", "text", ["doc_id"]), substrings.repeats(none, "doc_id", "text"),
        packing.pack(none, "doc_id", "text", TOKENIZER, public_tokenizers.PATTERN), imatch.fingerprint_pairs(none, "doc_id", "text"),
        roles.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
    ]
    usable = blockknn.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    frames.append(blockknn.nearest(usable, usable, 3))
    assert [f.count() for f in frames] == [0] * len(frames)


def test_chains_are_disjoint_and_follow_order():
    rng = random.Random(9)
    found = sorted({(rng.randrange(400), rng.randrange(400), rng.randrange(6, 30)) for _ in range(200)})
    paths = substrings.chain(found)
    used = [i for p in paths for i in p]
    assert sorted(used) == list(range(len(found)))
    for p in paths:
        for i, j in zip(p, p[1:]):
            assert found[i][0] < found[j][0] and found[i][1] + found[i][2] <= found[j][1] + substrings.K
    line = [(i, i, 10) for i in range(0, 200, 20)]
    assert substrings.chain(line) == [list(range(10))]
    many = [(20 * i, 5, 8) for i in range(4000)]  # one line again and again: no chain joins two of them
    assert len(substrings.chain(many)) == 4000


def edited(words, rng):
    """The words with one put in after every 12 to 20."""
    out = []
    while words:
        n = rng.randrange(12, 21)
        out, words = [*out, *words[:n], f"in{rng.randrange(10**6)}"], words[n:]
    return out


def test_fuzzy_passage_after_an_exact_one():
    found = [(0, 0, 60), *((160 + 15 * i, 160 + 14 * i, 12) for i in range(5))]
    assert sorted(substrings.chain(found)) == [[0], [1, 2, 3, 4, 5]]
    fork = [(0, 0, 30), (40, 40, 30), (46, 31, 8), (60, 44, 8)]  # the last two follow the first less well than the second does
    assert sorted(substrings.chain(fork)) == [[0, 1], [2, 3]]


def test_fuzzy_passage_after_an_exact_one_is_reported(spark):
    rng = random.Random(10)
    exact, fuzzy = [f"e{i}" for i in range(60)], [f"f{i}" for i in range(90)]
    gap = [prose(rng, 100, 10**6) for _ in range(2)]
    texts = [" ".join([*exact, gap[0], *fuzzy]), " ".join([*exact, gap[1], *edited(fuzzy, rng)])]
    got = sorted((r["from_word"], r["to_word"]) for r in substrings.repeats(docs(spark, texts), "doc_id", "text").collect())
    assert len(got) == 2 and got[0] == (0, 60) and got[1][0] <= 166 and got[1][1] >= 250


def test_parts_of_a_chain_with_too_few_equal_words(spark):
    rng = random.Random(11)
    own = lambda n: prose(rng, n, 10**6)
    a, b, c, d = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 55), ("b", 55), ("c", 60), ("d", 30)))
    long = [[f"l{k}_{i}" for i in range(60)] for k in range(4)]
    pairs = [
        ([*a, own(50), *b], [*a, own(50), *b], [(0, 55), (105, 160)]),
        ([*c, own(40), *d], [*c, own(40), *d], [(0, 60)]),
        (sum(([*p, own(50)] for p in long), []), sum(([*p, own(50)] for p in long), []), [(110 * k, 110 * k + 60) for k in range(4)]),
    ]
    texts = [" ".join(p[0]) for p in pairs] + [" ".join(p[1]) for p in pairs]
    got = substrings.repeats(docs(spark, texts), "doc_id", "text").collect()
    for i, (_, _, want) in enumerate(pairs):
        mine = sorted((r["from_word"], r["to_word"], r["equal_words"]) for r in got if r["doc_id"] == 3 + i)
        assert mine == [(x, y, y - x) for x, y in want]


def test_parts_are_the_longest_by_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(20):
        a = np.arange(400, dtype="<u4")
        b = a.copy()
        for x in rng.integers(0, 400, 6):
            b[x : x + rng.integers(5, 60)] += 1000
        same = np.concatenate([[0], np.cumsum(a == b)])
        best = max((j - i for i in range(400) for j in range(i + 25, 401) if a[i] == b[i] and a[j - 1] == b[j - 1] and same[j] - same[i] >= 0.8 * (j - i)), default=0)
        got = substrings.parts(a, b, [(0, 0, 400)])
        assert max((j - i for i, j, _ in got), default=0) == best and all(n == same[j] - same[i] for i, j, n in got)


def test_passage_whose_pieces_stand_in_earlier_texts(spark):
    rng = random.Random(13)
    own = lambda: prose(rng, 40, 10**6)
    for edit in (False, True):
        whole = [f"q{i}" for i in range(80)]
        texts = [" ".join([own(), *whole[a:b], own()]) for a, b in ((0, 24), (19, 42), (38, 61), (57, 80))]
        fuzzy = edited(whole, rng) if edit else whole
        texts += [" ".join([own(), *fuzzy, own()]), " ".join([own(), *(edited(fuzzy, rng) if edit else whole), own()])]
        got = substrings.repeats(docs(spark, texts), "doc_id", "text").collect()
        assert [(r["doc_id"], r["source_ids"]) for r in got if 4 in r["source_ids"]] == [(5, [4])]
        assert max(r["to_word"] - r["from_word"] for r in got) >= 70


def test_toxic_words_behind_trailing_doubled_and_spaced_disguise():
    rng = random.Random(14)
    counts = np.zeros(toxicity.ALPHABET**3, np.int64)
    for word in ["you", "idiot", "ass", "kill", "shit", "stone", "tide", "moral", "fool"] * 50:
        code = [0, 0, *map(toxicity.symbol, word), 0]
        for a, b, c in zip(code, code[1:], code[2:]):
            counts[(a * toxicity.ALPHABET + b) * toxicity.ALPHABET + c] += 1
    model = toxicity.CharModel(counts)
    cases = {"a$$": "ass", "ki11": "kill", "sh1+": "shit", "@$$": "ass", "f00l": "fool", "i d 1 o t": "idiot", "y o u i d i o t": "idiot", "$hi+!": "shit",
             " ".join("stone" * 20 + "idiot"): "idiot"}
    for disguise, word in cases.items():
        text = f"{prose(rng, 5)} , {disguise}\nMORAL (tide) 1234 moral!"
        assert word in toxicity.restored(text, model, {}), disguise
        texts = toxicity.Texts(toxicity.pa.array([text, "moral, tide"]))
        rows, hashes = toxicity.features(texts, 0, 2, model, {})
        assert rows[hashes == toxicity.hash_words([word])[0]].tolist().count(0) >= 1
    assert toxicity.restored("12 345 moral. 1 2 3 4", model, {}) == []


def test_chain_scores_by_brute_force():
    rng = random.Random(15)
    for _ in range(200):
        span = rng.choice((60, 400))
        found = sorted({(rng.randrange(span), rng.randrange(span), rng.randrange(6, 30)) for _ in range(rng.randrange(1, 80))})
        left = sorted(rng.sample(range(len(found)), rng.randrange(1, len(found) + 1)))
        score, before = substrings._scored(found, left)
        for i in left:
            x, y, n = found[i]
            gains = [0.0]
            for j in left:
                gap_x, gap_y = x - found[j][0] - found[j][2], y - found[j][1] - found[j][2]
                if found[j][0] < x and -substrings.K < gap_x <= substrings.MAX_GAP and -substrings.K < gap_y <= substrings.MAX_GAP:
                    gains.append(score[j] - substrings.GAP_COST * (gap_x + gap_y))
                    if j == before[i]:
                        assert abs(score[i] - n - gains[-1]) < 1e-9
            assert abs(score[i] - n - max(gains)) < 1e-9 and (before[i] >= 0) == (max(gains) > 0)


def test_tree_of_maxima_by_brute_force():
    rng = random.Random(16)
    for n in (1, 2, 7, 64, 100):
        tree, plain = substrings.MaxTree(n), [substrings.MaxTree.NONE] * n
        for _ in range(400):
            p = rng.randrange(n)
            plain[p] = rng.choice([substrings.MaxTree.NONE, (float(rng.randrange(9)), -rng.randrange(3))])
            tree.put(p, plain[p])
            lo, hi = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
            assert tree.most(lo, hi) == max(plain[lo:hi], default=substrings.MaxTree.NONE)


def test_text_that_repeats_one_word_is_one_passage(spark):
    rng = random.Random(17)
    own = lambda n: prose(rng, n, 10**6).split()
    first = [*own(50), *["z"] * 40, *own(50)]
    later = [*own(30), *["z"] * 3000, *first[90:], *own(20)]
    got = substrings.repeats(docs(spark, [" ".join(first), " ".join(later), "z " * 2000]), "doc_id", "text").collect()
    mine = {r["doc_id"]: (r["from_word"], r["to_word"], r["equal_words"]) for r in got}
    assert mine[1] == (30, 3080, 3050) and mine[2] == (0, 2000, 2000) and len(got) == 2
    x = np.arange(0, 1000, 4)
    assert substrings.runs_of(x, np.zeros_like(x)) == [(0, 996, 0)] and substrings.runs_of(x * 10, np.zeros_like(x)) == []


def test_a_passage_whose_pieces_meet_its_source_in_different_rounds(spark):
    """Three pieces, too short for a passage, stand alone in 5, 15 and 40 earlier texts; rounds without gain come before the source is met."""
    rng = random.Random(23)
    pieces = [[f"{c}{i}" for i in range(20)] for c in "abc"]
    alone = [f"{prose(rng, 30, 10**6)} {' '.join(p)} {prose(rng, 30, 10**6)}" for p, n in zip(pieces, (5, 15, 40)) for _ in range(n)]
    whole = [" ".join([prose(rng, 20, 10**6), *pieces[0], f"x{i}", *pieces[1], f"y{i}", *pieces[2], prose(rng, 20, 10**6)]) for i in range(2)]
    got = substrings.repeats(docs(spark, alone + whole), "doc_id", "text").collect()
    assert [(r["doc_id"], r["from_word"], r["to_word"], r["source_ids"], r["equal_words"]) for r in got] == [(61, 20, 82, [60], 60)]


def test_fuzzy_passage_whose_seeds_stand_in_many_earlier_texts(spark):
    rng = random.Random(18)
    own = lambda: prose(rng, 40, 10**6)
    whole = [f"q{i}" for i in range(80)]
    pieces = [" ".join([own(), *whole[a : a + 12], own()]) for a in range(0, 70, 6) for _ in range(2)]
    pair = [" ".join([own(), *edited(whole, rng), own()]) for _ in range(2)]
    got = [r for r in substrings.repeats(docs(spark, pieces + pair), "doc_id", "text").collect() if r["doc_id"] == len(pieces) + 1]
    assert any(len(pieces) in r["source_ids"] and r["to_word"] - r["from_word"] >= 70 for r in got)


def test_a_frequent_short_sentence_joins_no_texts(spark, monkeypatch):
    rnd, sentence = random.Random(3), " ".join(f"s{i}" for i in range(13))
    own = lambda n: " ".join(f"w{rnd.randrange(10**9)}" for _ in range(n))
    chained = []
    passages = substrings._passages
    monkeypatch.setattr(substrings, "_passages", lambda base, matches: chained.append(matches.count()) or passages(base, matches))
    assert substrings.repeats(docs(spark, [f"{own(90)} {sentence} {own(90)}" for _ in range(40)]), "doc_id", "text").count() == 0
    assert chained[0] and not sum(chained[1:])  # each with the first text that has it, and no others


def test_seeds_of_two_rounds_near_each_other_are_chained(spark):
    # text 1 has the first half and the fuzzy rest that stands in others too, so a seed of the rest meets text 1 in a later round than the first half
    rnd = random.Random(5)
    half, rest = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = [own(80) + rest[10 * i : 10 * i + 10] + own(80) for i in range(4)] + [own(60) + half + own(3) + rest + own(60), own(90) + half + own(2) + rest + own(9)]
    got = substrings.repeats(docs(spark, [" ".join(t) for t in texts]), "doc_id", "text").collect()
    assert [(r["doc_id"], r["from_word"], r["to_word"]) for r in got if 4 in r["source_ids"]] == [(5, 90, 172)]


def test_common_words_in_a_band_by_brute_force():
    rng = random.Random(33)
    for _ in range(300):
        x, y = ([rng.randrange(rng.choice((3, 30))) for _ in range(rng.randrange(0, 25))] for _ in range(2))
        band = abs(len(x) - len(y)) + rng.randrange(0, 6)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x[i] == y[j] and abs(i - j) <= band))
        assert substrings.common(np.array(x, "<u4"), np.array(y, "<u4"), band) == best[-1][-1]


def test_rows_are_made_of_repeated_seeds_alone(spark):
    rng = random.Random(31)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [prose(rng, 200, 10**9) for _ in range(40)] + [f"{prose(rng, 40, 10**9)} {passage}" for _ in range(3)] + [None, "", "one two"]
    base = docs(spark, texts).selectExpr("doc_id", "text as text_")
    seeds = substrings.map_blocks(base, "text_", ["doc_id"], "seed long, new boolean, place int, size tinyint", substrings._seeds, rows="of_row")
    shared = seeds.groupBy("seed").agg(F.countDistinct("doc_id").alias("n")).where("n > 1")
    want = {tuple(r) for r in seeds.join(shared.select("seed"), "seed").select(*seeds.columns).collect()}
    got = {tuple(r) for r in substrings._repeated(base).collect()}
    assert want and want <= got and len(got) < len(want) + 40


def test_rounds_done_together_give_the_rows_of_rounds_done_alone(spark, monkeypatch):
    rng = random.Random(32)
    own = lambda n=30: prose(rng, n, 10**6)
    whole, other = [f"q{i}" for i in range(80)], [f"r{i}" for i in range(30)]
    texts = [" ".join([own(), *whole[a : a + 20], own()]) for a in range(0, 61, 20) for _ in range(1 + a // 2)]
    texts += [" ".join([own(), *edited(whole, rng), own(), *other, own()]) for _ in range(8)] + [" ".join([own(), *edited(other, rng), own()]) for _ in range(25)]
    joins, stopped, rows = [], [], []
    matches, stops = substrings._matches, substrings._stops
    monkeypatch.setattr(substrings, "_matches", lambda *a: joins.append(1) or matches(*a))

    def counted(*a):
        found = stops(*a)
        stopped.append(found.count())
        return found

    monkeypatch.setattr(substrings, "_stops", counted)
    for most in (0, 10**6):
        monkeypatch.setattr(substrings, "TOGETHER", most)
        joins.clear()
        found = substrings.repeats(docs(spark, texts), "doc_id", "text").collect()
        rows.append((len(joins), sorted((r["doc_id"], r["from_word"], r["to_word"], r["source_ids"], r["equal_words"]) for r in found)))
    assert rows[0][1] == rows[1][1] and rows[1][1] and rows[1][0] < rows[0][0] and sum(stopped)


def test_pairs_are_not_dealt_by_a_join_before_they_are_chained(spark, monkeypatch):
    rng = random.Random(23)
    pieces = [[f"{c}{i}" for i in range(20)] for c in "abc"]
    alone = [f"{prose(rng, 30, 10**6)} {' '.join(p)} {prose(rng, 30, 10**6)}" for p, n in zip(pieces, (5, 15, 40)) for _ in range(n)]
    whole = [" ".join([prose(rng, 20, 10**6), *pieces[0], f"x{i}", *pieces[1], f"y{i}", *pieces[2], prose(rng, 20, 10**6)]) for i in range(2)]
    plans, passages = [], substrings._passages
    monkeypatch.setattr(substrings, "_passages", lambda base, matches: plans.append(matches._jdf.queryExecution().toString()) or passages(base, matches))
    substrings.repeats(docs(spark, alone + whole), "doc_id", "text").count()
    assert len(plans) > 2 and not any("Join" in p for p in plans)


def _moved(plan: str) -> list[str]:
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_few_labels_and_few_ids_move_no_texts(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i // 2, i % 3 % 2) for i in range(60)] + [(None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = toxicity.labelled_rows(frame, labels, "doc_id", "text")
        assert "BroadcastHashJoin" in (plan := rows._jdf.queryExecution().toString()) and not _moved(plan)
        want = {}
        for i in range(60):
            want[i // 2] = max(want.get(i // 2, 0), i % 3 % 2)
        assert {(r["text"], r["toxic"]) for r in rows.collect()} == {(f"text {i}", t) for i, t in want.items()}
        plans, stored = [], neardup.stored
        monkeypatch.setattr(neardup, "stored", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or stored(df, name))
        sets = neardup.sets_of(frame.selectExpr("doc_id as cls", "text as text_"), spark.range(0, 50, 5).toDF("cls"))
        assert sorted((r["cls"], len(r["grams"])) for r in sets.collect()) == [(i, 1) for i in range(0, 50, 5)]
        assert "BroadcastHashJoin" in plans[-1] and not _moved(plans[-1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sentences_too_short_for_a_passage_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(27)
    sentence, seen, matches = prose(rng, 35, 10**6), [], substrings._matches
    own = lambda n: prose(rng, n, 10**6)
    monkeypatch.setattr(substrings, "_matches", lambda *a: seen.append(matches(*a)) or seen[-1])
    texts = [f"{own(90)} {sentence} {own(90)}" for _ in range(30)] + [" ".join([own(90), *["z"] * 40, own(90)]) for _ in range(30)]
    assert substrings.repeats(docs(spark, texts), "doc_id", "text").count() == 0
    assert sum(m.count() for m in seen) == 0


def test_passages_without_the_comparisons_left_out_are_the_same(spark, monkeypatch):
    rng = random.Random(28)
    own = lambda n: prose(rng, n, 10**6).split()
    lines = [own(n) for n in (26, 30, 34, 40, 44, 48)]

    def piece():
        kind = rng.randrange(4)
        if kind == 0:  # junk: a word many times over
            return [f"z{rng.randrange(4)}"] * rng.randrange(15, 49)
        line = rng.choice(lines)
        if kind == 1:
            return line
        if kind == 2:
            a = rng.randrange(len(line) - 20)
            return line[a : a + rng.randrange(20, 49)]
        return [w if rng.random() > 0.08 else own(1)[0] for w in line]

    texts = [" ".join(w for _ in range(rng.randrange(1, 4)) for w in [*piece(), *own(rng.choice((0, 0, 3, 12, 40)))]) for _ in range(24)]
    found = lambda: sorted(map(tuple, substrings.repeats(docs(spark, texts), "doc_id", "text").collect()))
    some = found()
    monkeypatch.setattr(substrings, "_open", lambda rows, long, least: substrings._uncovered(rows, long))
    monkeypatch.setattr(substrings, "_hopeful", lambda base, keys, *a: keys.drop("lo", "hi", "earlier"))
    assert some and some == found()
