import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from public_tokenizers import path

from vaultspark.llm import common, decontamination, exact_dedup, jaccard_join, language_id, line_dedup, pieces, pii, quality, token_counts, toxicity

DATA = "/root/testdata/sf0.01"
MODEL, WORDS = path("piece_bpe_32k.model"), path("word_bpe_49k.json")
LONG = "word " * 40_000
#: Null, empty, blank, one word, ties, repeated rows, a null id, a very long text; columns with clashing names.
MESSY = [
    (1, None), (2, ""), (3, " \n\t"), (4, "A"), (5, "a"), (6, "one two three four five six\nsome line of text\n"), (7, "ONE two three four five six\nsome line of text\n"),
    (7, "ONE two three four five six\nsome line of text\n"), (None, "one two three four five six\nsome line of text\n"), (8, LONG), (9, LONG.upper()), (10, "!!! 123 ..."), (11, "é" * 50 + "😀"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n long, label string, row long, sha string, token long"


def messy(spark, rows=MESSY):
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None, 0, "x", 1, None, 2) for i, t in rows], SCHEMA).repartition(3)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")


def test_exact_duplicates(spark):
    got = exact_dedup.exact_duplicates(messy(spark), first_digit=4, growth=3).collect()
    texts = sorted((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for _, t in MESSY)
    assert sorted(r["text_sha256"] for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["keep_id"] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [2, 2, 3, 5, 5, 7, 7, 9, 9]
    assert by[6]["group_size"] == 4 and by[None]["keep_id"] == 7 and not by[None]["kept"]
    assert sum(r["kept"] for r in got if r["doc_id"] == 7) == 2  # rows that repeat an id share its decision
    assert exact_dedup.exact_duplicates(messy(spark, [])).count() == 0
    nameless = {(r["doc_id"], r["text_sha256"][:3]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(messy(spark, [(None, "alone"), (None, "b"), (4, "B")])).collect()}
    assert sorted(nameless.values(), key=str) == [(4, 2, False), (4, 2, True), (None, 1, True)]


def families(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            i, r = draw.randrange(len(w)), draw.random()
            if r < 0.4:
                w[i] = draw.choice(vocabulary)
            elif r < 0.6 and len(w) > 3:
                del w[i]
            elif r < 0.8:
                w.insert(i, draw.choice(vocabulary))
            else:
                w = w[: max(6, len(w) - draw.randrange(1, 12))]
        return w

    docs, passage = [], [draw.choice(vocabulary) for _ in range(60)]
    for f in range(6):
        pool = [[draw.choice(vocabulary) for _ in range(draw.choice([8, 30, 80, 150]))] + passage * (f % 2)]
        for _ in range(20):
            pool.append(edited(draw.choice(pool), draw.choice([0, 1, 2, 3, 5, 8])))
        docs += pool
    return [(3 * i + 20, " ".join(w)) for i, w in enumerate(docs)]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    rows = [r for r in MESSY if r[0] is not None] + families(4)
    want = brute_components(rows)
    got = jaccard_join.near_duplicates(messy(spark, [*rows, (None, "one two three four five six")])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert len(got) == len(rows) + 1


def test_near_duplicates_in_one_large_group(spark):
    draw = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    common = [draw.choice(vocabulary) for _ in range(90)]
    rows = []
    for f in range(3):  # three originals that share most of their text, each with many copies of all degrees
        own = common + [draw.choice(vocabulary) for _ in range(30)]
        rows.append((10 * len(rows) + 7, " ".join(own)))
        for _ in range(660):
            w = list(own)
            for _ in range(int(draw.random() ** 2 * 12)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            rows.append((10 * len(rows) + 7, " ".join(w)))
    draw.shuffle(rows)
    runs = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    place = {x: k for k, x in enumerate(sorted(set().union(*runs)))}
    holds = np.zeros((len(rows), len(place)), np.float32)
    for k, own in enumerate(runs):
        holds[k, [place[x] for x in own]] = 1
    both, size = holds @ holds.T, holds.sum(1)
    links = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    label, before = np.array([i for i, _ in rows]), None
    while before is None or (label != before).any():
        before, label = label, np.array([label[links[k]].min() for k in range(len(rows))])
    got = jaccard_join.near_duplicates(messy(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(runs[k]), label[k]) for k, (i, _) in enumerate(rows)}


def test_words_that_fool_polynomial_hashes(spark):
    one = "a"
    for _ in range(11):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(messy(spark, [(1, one), (2, two), (3, one[:200]), (4, two[:200])])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_near_duplicates_of_nothing(spark):
    assert jaccard_join.near_duplicates(messy(spark, [])).count() == 0


def test_pieces(spark):
    """Codes against the library's, and against scores over all segmentations."""
    p, library = pieces.pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert p.by_merges
    usable = {x: i for x, i in p.number.items() if p.merged(x) == [i]}

    def best(text):
        top = [0.0] + [float("-inf")] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 20), end):
                i = usable.get(text[start:end])
                if i is not None:
                    top[end] = max(top[end], top[start] + p.scores[i])
            if text[end - 1] not in usable:
                top[end] = max(top[end], top[end - 1] + p.bridge)
        return top[-1]

    draw = random.Random(2)
    bits = ["the", "and", " ", "  ", "   ", "x", ",", "é", "\n", "tion", "😀", "ing", "日本", "==", "----", "Ünder", "http://", "23", "ß", "\u0301", "l", " а"]
    for _ in range(2000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(1, 12)))
        ids = list(p.encode(text))
        assert ids == library.encode(text) and p.decode(ids) == text
        own = text.replace("x", "▁") + "▁"
        assert p.decode(p.encode(own)) == own
    for _ in range(200):
        text = "▁" + "".join(draw.choice(bits) for _ in range(draw.randrange(1, 6))).replace(" ", "▁")
        ids = p.best_path(text)
        bridged = sum(c not in usable for c in text)
        assert sum(p.scores[i] for i in ids if i not in p.bytes.values()) + bridged * p.bridge == pytest.approx(best(text))
    for r in spark.read.parquet(f"{os.path.dirname(DATA)}/sf0.001/documents.parquet").collect():
        assert list(p.encode(r["text"] or "")) == library.encode(r["text"] or "")
    rows = pieces.encode(messy(spark), MODEL)
    assert all(r["decoded_ok"] for r in rows.collect())
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, MODEL).collect()}
    assert back[8] == LONG and back[1] == "" and back[11] == "é" * 50 + "😀"


def test_token_counts(spark):
    c = token_counts.counter(WORDS)
    draw = random.Random(3)
    texts = [t or "" for _, t in MESSY] + ["".join(draw.choice(["the ", "Cat", "'s", "<|endoftext|>", "É", "Σ", "ς", "1", "-", "́", "İ", "  "]) for _ in range(9)) for _ in range(300)]
    assert [c.count(t) for t in texts] == [len(c.library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = {r["doc_id"]: r for r in token_counts.token_counts(messy(spark), WORDS).collect()}
    assert got[8]["over_limit"] and got[8]["n_bytes"] == len(LONG) and got[1]["n_tokens"] == 0
    assert token_counts.token_counts(messy(spark, []), WORDS).count() == 0


def test_lines_against_sql(spark):
    rows = [r for k, r in enumerate(MESSY) if r[0] is not None and k != 7] + [(20, "some line of text\nown line number one\n\n  SOME line of text "), (21, "own line number one"), (22, "\n\n")]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(line_dedup.ORACLE).fetchall()}
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.without_repeats(messy(spark, rows)).collect()}
    assert got == want
    assert got[20][1] == 2
    beyond = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.without_repeats(messy(spark, rows), most_bits=0).collect()}
    assert beyond == want
    assert line_dedup.without_repeats(messy(spark, [])).count() == 0
    assert line_dedup.without_repeats(messy(spark, [*rows, (None, "some line of text")])).where("doc_id is null").first()["n_dropped"] == 0


def naive_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(spark):
    draw = random.Random(4)
    bits = ["1", "25", "0", ".", "@", "+", " ", "-", "a", "(", "00000001", "4111111111111111", "x.y", "é", "+1 (476) 555-6291", "\n"]
    for _ in range(3000):
        t = "".join(draw.choice(bits) for _ in range(draw.randrange(25)))
        assert pii.base_spans(t)[0] == naive_spans(t)
    model = pii.learn(spark.read.parquet(f"{DATA}/documents.parquet"))
    again = "call +1 (476) 555-6291. Later: (476) 555-6291 again"
    rows = [*MESSY, (30, again), (31, "9" * 5000 + " " + "1." * 3000 + " " + "a" * 5000 + "@")]
    got = {r["doc_id"]: r for r in pii.detect(messy(spark, rows), model).collect()}
    assert got[30]["spans"] == "phone:5:22,phone:31:45"
    assert got[30]["n_phone"] == 1 and got[30]["base_sha256"] == hashlib.sha256(b"phone:5:22").hexdigest()
    assert got[1]["spans"] == ""
    assert pii.personal_data(messy(spark, [])).count() == 0


def enumerated(t, model):
    """Label probabilities of each node, from all labellings."""
    node = pii._rows(np.array([pii._code(s) for s in t.shapes])) @ model["token"]
    total = np.zeros((len(node), pii.OTHER + 1))
    for labels in itertools.product(range(pii.OTHER + 1), repeat=len(node)):
        if any(k >= 0 and k != y for k, y in zip(t.label, labels, strict=True)):
            continue
        z = sum(node[i, y] for i, y in enumerate(labels)) + sum(model["chain"][labels[i], labels[j]] for i, j in t.chain) + sum(model["skip"][labels[i], labels[j]] for i, j in t.skip)
        for i, y in enumerate(labels):
            total[i, y] += np.exp(z)
    return total / total.sum(1, keepdims=True)


def test_messages_against_enumeration():
    draw = np.random.default_rng(3)
    model = {"token": draw.normal(size=(pii.OFFSETS[-1], 5)) / 3, "chain": draw.normal(size=(5, 5)) / 2, "skip": draw.normal(size=(5, 5)) / 2}
    model["skip"] = (model["skip"] + model["skip"].T) / 2
    for text, tree in (("a1 b2@c 33", True), ("x 5551234 y 555-1234 z", True), ("q@w.de +1 (222) 333-4444 then 222-333-4444", True), ("a1 b2 c3 d a1 e c3", False), ("7654321 8@z 7654321 9@z 7654-321", False)):
        t = pii.Tokens(text, *pii.base_spans(text))
        got, want = pii.marginals(t, model), enumerated(t, model)
        assert len(t.spans) >= 2 and np.abs(got - want).max() < (1e-3 if tree else 0.1), text
    for code in range(4):  # a gradient that is 0 at the optimum: probabilities of each class agree with how often it is
        rows = draw.integers(0, 300, 200), *(draw.integers(-1, 5, 200) for _ in range(3)), draw.integers(0, 5, 200)
        fitted = pii.fit(*rows, np.ones(200))
        assert np.abs(fitted["token"]).max() < 30 and np.allclose(fitted["skip"], fitted["skip"].T)


def test_entities_in_other_forms(spark):
    """Spans that only the field's skip edges find: entities once more in forms that the patterns miss, and such forms without a twin."""
    docs = spark.read.parquet(f"{os.path.dirname(DATA)}/sf0.1/documents.parquet")
    model = pii.learn(docs.where("doc_id % 2 = 0"))
    blind = model | {"skip": np.zeros((5, 5))}
    draw, hits, false, blind_hits, n = random.Random(5), 0, 0, 0, 0
    for r in docs.where("doc_id % 2 = 1").orderBy("doc_id").limit(2500).collect():
        text = r["text"] or ""
        found, _ = pii.base_spans(text)
        if not found:
            continue
        kind, a, b = draw.choice(found)
        form, noise = pii.altered(text[a:b], kind, draw.randrange(30)), pii.altered(text[a:b], kind, draw.randrange(30), True)
        new = f"{text}\nOnce more we saw {form} and {noise} there"
        start = len(text) + 18
        found, failed = pii.base_spans(new)
        if any(x[2] > len(text) for x in found):
            continue
        got = pii.added(new, found, failed, model, 0.9)
        n += 1
        hits += (kind, start, start + len(form)) in got
        false += len([x for x in got if x[1:] != (start, start + len(form))])
        blind_hits += len(pii.added(new, found, failed, blind, 0.9))
    assert n > 50 and hits / n > 0.95 and false / n < 0.02 and blind_hits / n < 0.05, (n, hits, false, blind_hits)


def test_test_items(spark):
    draw = random.Random(5)
    w = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    items = [[draw.choice(w) for _ in range(n)] for n in (8, 20, 60)]
    noise = lambda n: [draw.choice(w) for _ in range(n)]
    spoiled = [x if k % 6 else "zzzzz" for k, x in enumerate(items[2])]
    docs = [*MESSY, (40, " ".join(noise(50) + items[0] + noise(50))), (41, ", ".join(noise(9) + items[1]).upper()), (42, " ".join(noise(200) + spoiled + noise(9))), (43, " ".join(noise(400)))]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(7, None), (8, "a b"), (None, "x y z"), (0, " ".join(items[0]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(messy(spark, docs), bench).collect()}
    assert set(got) == {(40, 0), (41, 1), (42, 2)}
    assert got[40, 0]["score"] == 1.0 and (got[40, 0]["first_word"], got[40, 0]["last_word"]) == (50, 58)
    assert decontamination.contaminated(messy(spark), bench.limit(0)).count() == 0


def test_test_items_by_exact_copies(spark):
    draw = random.Random(7)
    w = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    item = [draw.choice(w) for _ in range(60)]
    spoiled = [x if k % 6 else "zzzzz" for k, x in enumerate(item)]
    one_seed = [x if k < 3 or k % 3 else "zzzzz" for k, x in enumerate(item)]  # one run of three words, then runs of two
    noise = lambda n: [draw.choice(w) for _ in range(n)]
    bench = spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")
    for copies in (0, 1, 5):
        docs = [(60 + k, " ".join(noise(20) + item + noise(20))) for k in range(copies)]
        docs += [(42, " ".join(noise(200) + spoiled + noise(9))), (44, " ".join(noise(30) + one_seed + noise(30))), (43, " ".join(noise(400)))]
        got = {r["doc_id"]: r["score"] for r in decontamination.contaminated(messy(spark, docs), bench).collect()}
        assert set(got) == {42, 44, *range(60, 60 + copies)}
        assert got[42] >= 0.75 and all(got[60 + k] == 1.0 for k in range(copies))


def naive_align(item, passage):
    best = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            best[i][j] = max(0, best[i - 1][j - 1] + (2 if a == b else -1), best[i - 1][j] - 1, best[i][j - 1] - 1)
    return max(map(max, best)) / (2 * len(item))


def test_alignment_against_brute_force():
    draw = random.Random(6)
    for _ in range(200):
        item, passage = ([draw.randrange(5) for _ in range(draw.randrange(1, 14))] for _ in range(2))
        got, start, stop = decontamination.align(np.array(item, np.uint64), np.array(passage, np.uint64))
        assert got == naive_align(item, passage) == naive_align(item, passage[start:stop])


def test_recall_of_edited_items(spark):
    """Seeds against a full alignment of each copy, on the items of the benchmark."""
    draw = random.Random(9)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r["item_id"], re.findall(r"[^\x00-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))) for r in bench.collect()]
    items = [(i, w) for i, w in items if len(w) >= 8]
    vocabulary = sorted({x for _, w in items for x in w})
    noise = lambda: [draw.choice(vocabulary) for _ in range(30)]
    docs, share = [], {}
    for rate in (0.1, 0.2, 0.3, None):
        for i, w in draw.sample(items, min(60, len(items))):
            if rate is None:
                copy = [x if k % 3 != 2 else draw.choice(vocabulary) for k, x in enumerate(w)]
            else:
                copy = []
                for x in w:
                    r = draw.random() / rate
                    copy += [x] if r >= 1 else [draw.choice(vocabulary)] if r < 0.5 else [] if r < 0.75 else [x, draw.choice(vocabulary)]
            doc = noise() + copy + noise()
            docs.append((len(docs), " ".join(doc)))
            share[len(docs) - 1] = (rate, i, naive_align(w, doc))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(messy(spark, docs), bench).collect()}
    for rate in (0.1, 0.2, 0.3, None):
        want = [(d, i) for d, (r, i, s) in share.items() if r == rate and s >= 0.5]
        assert want and sum(x in got for x in want) / len(want) >= 0.97, rate


def test_items_of_one_id(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (1, None)], "item_id long, text string")
    docs = [(1, "x alpha beta gamma delta epsilon zeta y"), (2, "q one two three four five six seven"), (3, "one two three four five six seven alpha beta gamma delta epsilon zeta"), (4, "other words")]
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(messy(spark, docs), bench).collect()]
    assert sorted(got) == [(1, 1), (2, 1), (3, 1)]
    assert [r["doc_id"] for r in decontamination.clean(messy(spark, docs), bench).collect()] == [4]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.learn(docs)
    rows = [(r["lang_pred"] == r["lang"], r["held_out"] == held_out(r["doc_id"])) for r in language_id.detect(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()]
    assert sum(a for a, _ in rows) / len(rows) > 0.98 and all(b for _, b in rows)
    got = {r["doc_id"]: r for r in language_id.detect(messy(spark), model).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 10}
    one, two = (docs.where(f"lang = '{x}' and n_chars between 1500 and 3000").first()["text"] for x in ("en", "de"))
    mixed = language_id.detect(messy(spark, [(50, f"{one} {two}")]), model).first()
    assert '"en"' in mixed["shares"] and '"de"' in mixed["shares"]
    assert language_id.identify(messy(spark, [])).count() == 0


def test_mixture_against_search():
    """Shares against a search over all mixtures in steps of a hundredth; sets against all sets."""
    draw = np.random.default_rng(4)
    for _ in range(12):
        table = draw.dirichlet(np.full(40, 0.3), 3).T  # bins by languages
        truth = draw.dirichlet([0.6, 0.6, 0.6])
        many = np.bincount(draw.choice(40, 3000, p=table @ truth), minlength=40)
        like = table / table.max(1, keepdims=True)
        got, total = language_id.shares(like, np.full(3, 1 / 3), many, rounds=400, settled=1e-7)
        grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
        score = lambda s: float(many @ np.log(np.maximum(like @ s, 1e-30)))
        best = max(grid, key=score)
        assert total >= score(best) - 0.5 and np.abs(got - best).max() < 0.03
        each, _ = language_id.shares(np.repeat(like, many, axis=0), np.full(3, 1 / 3), rounds=400, settled=1e-7)
        assert np.allclose(got, each, atol=1e-3)  # a bin counted once with its number, or as often as it occurs
        index, share = language_id.mixture(like, 8.0, many)
        price = lambda m: 4.0 * m * np.log(many.sum())
        sets = {c: language_id.shares(like[:, c], np.full(len(c), 1 / len(c)), many, rounds=400, settled=1e-7)[1] - price(len(c)) for m in (1, 2, 3) for c in itertools.combinations(range(3), m)}
        assert sets[tuple(sorted(index.tolist()))] >= max(sets.values()) - 2.0 and share.sum() == pytest.approx(1)


def test_ranking_against_brute_force():
    """Weights against plain gradient descent over all pairs; the cut against a count."""
    draw = np.random.default_rng(5)
    x = draw.normal(size=(60, 4)).astype(np.float32)
    y = (x @ [1.0, -2.0, 0.5, 0.0] + draw.normal(size=60) > 0.3).astype(int)
    apart = (x[y == 1][:, None, :] - x[y == 0][None, :, :]).reshape(-1, 4).astype(float)
    w = np.zeros(4)
    for _ in range(4000):
        w -= 0.5 * (-(apart * (1 / (1 + np.exp(apart @ w)))[:, None]).mean(0) + 1e-3 * w)
    got = quality.rank(x, y, rounds=600)
    assert got @ w / np.linalg.norm(got) / np.linalg.norm(w) > 0.995
    loss = lambda v: np.log1p(np.exp(-apart @ v)).mean() + 5e-4 * v @ v
    assert loss(got) < loss(w) + 0.01


def test_chain_against_brute_force():
    """Out-of-fold probabilities and models against the same made row by row, each fold without its rows."""
    draw = np.random.default_rng(6)
    y = (draw.random(240) < 0.4).astype(int)
    texts = []
    for mark in y:
        words = [f"plain{k}" for k in draw.integers(0, 40, 20)] + [f"bad{k}" for k in draw.integers(0, 6, draw.integers(1, 5) * mark)]
        texts.append(" ".join(w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words))
    found, of = toxicity.bins(pa.array(texts))
    each = [np.unique(found[of[k] : of[k + 1]], return_counts=True) for k in range(len(y))]
    flat, many = (np.concatenate([e[i] for e in each]) for i in (0, 1))
    of = np.append(0, np.cumsum([len(e[0]) for e in each]))
    part = draw.integers(0, 3, len(y))
    view, models, unseen = toxicity.fit_chain(flat, of, many, y, part, 64, 5.0)

    def chosen(rows):
        scores = {}
        for b in set(flat.tolist()):
            one, no = (sum(b in each[k][0] for k in rows if y[k] == m) for m in (1, 0))
            n1, n0 = sum(y[rows]), len(rows) - sum(y[rows])
            p = (one + no) / len(rows)
            z = (one / n1 - no / n0) / np.sqrt(max(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
            if one + no >= 3 and abs(z) >= 5:
                scores[b] = (z, z > 8 and one / n1 > 5 * no / n0)
        return scores

    def matrix(names):
        return np.array([[np.log1p(dict(zip(*map(np.ndarray.tolist, each[k]), strict=True)).get(b, 0)) for b in names] for k in range(len(y))])

    want = np.zeros((len(y), 3))
    for j in range(3):
        for fold in range(3):
            rows = np.flatnonzero(part != fold)
            scores = chosen(rows)
            names = sorted(scores)
            x = matrix(names)
            hits = (x[:, [scores[b][1] for b in names]] > 0).sum(1)
            target = [y * (hits >= 1), y * (hits >= 3), y][j].astype(float)
            full = np.hstack([x, want[:, :j]])
            w, bias = toxicity.fit(full[rows], target[rows])
            out = part == fold
            want[out, j] = 1 / (1 + np.exp(-(full[out] @ w + bias)))
    assert set(view.chosen.tolist()) == set(chosen(np.arange(len(y)))) and list(models) == list(toxicity.CHAIN)
    assert np.abs(unseen - want).max() < 1e-3
    errors = [int(((unseen[:, -1] >= c) != y).sum()) for c in np.linspace(0, 1, 2001)]
    assert int(((unseen[:, -1] >= toxicity._threshold(unseen[:, -1], y)) != y).sum()) == min(errors)


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_learned_scores(spark, module, column):
    docs, marks = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = module.rate(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r[column] for r in got) / len(got) > 0.9
    unlearned = module.rate(messy(spark), labels(spark)).collect()
    assert len(unlearned) == len(MESSY) and all(0 <= r["score"] <= 1 for r in unlearned)
    few = labels(spark, [(i, i % 2, i % 2, None) for i in range(1, 12)] * 2 + [(None, 1, 1, None), (5, None, None, None)])
    assert all(0 <= r["score"] <= 1 for r in module.rate(messy(spark), few).collect())
    assert module.rate(messy(spark, []), few).count() == 0


def test_toxic_by_few_terms(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    plain, terms = [word() for _ in range(300)], ["zz" + word() for _ in range(10)]
    docs, marks = [], []
    for i in range(1, 3001):
        n = draw.choice([0] * 9 + [draw.choice([1, 1, 2, 2, 3, 4, 5, 6])])
        own = draw.sample(terms, n)
        docs.append((i, " ".join([draw.choice(plain) for _ in range(draw.randrange(20, 300))] + own)))
        marks.append((i, 0, int(n > 0) ^ (draw.random() < 0.01), None))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.rate(messy(spark, docs), labels(spark, marks)).where("held_out").collect()}
    count = {i: sum(t in text for t in terms) for i, text in docs}
    for n in (1, 2, 3):
        of = [got[i] for i in got if count[i] == n]
        assert len(of) > 3 and sum(of) / len(of) > 0.9, n
    clean = [got[i] for i in got if not count[i]]
    assert sum(clean) / len(clean) < 0.02


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    sf = os.path.dirname(DATA) + "/sf0.001"
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = [(i, t) for i, t in rows if re.search(r"[^\W\d_]", t or "")]
    last = {re.sub("[A-Z]", lambda m: m[0].lower(), t): i for i, t in sorted(rows)}
    rows = [(i, t) for i, t in rows if i in set(last.values())]
    rows = [(i, t) for i, t in rows if brute[i][1] == i] if (brute := brute_components(rows)) else rows
    word = lambda t: " ".join(re.findall(r"[^\W\d_]+", t.lower()))
    items = [word(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in word(t) for x in items)]
    assert set(got) == {i for i, _ in rows}
    p = pieces.pieces(MODEL)
    assert all(list(p.encode(t)) == got[i]["piece_ids"] for i, t in rows)


def test_pipeline_by_row(spark, tmp_path):
    import corpus_pipeline

    long, near = " ".join(f"word{k % 977} letter{k % 631}" for k in range(30_000)), [f"token{k} plain" for k in range(40)]
    rows = [
        (None, None), (1, ""), (2, "123 456"), (2, "the second text of this id is a proper sentence"), (None, "a text without an id stays where it is"), (None, "A text without an id stays where it is"),
        (5, "the same row twice in the table"), (5, "the same row twice in the table"), (6, long), (7, long.upper()), (8, " ".join(near)), (9, " ".join(near[:-1])), (9, "this row shares its id with a near copy"),
        (10, "zero one two three four five six seven eight nine"),
    ]
    spark.createDataFrame([(7, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", True) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row long, count string, there boolean").repartition(3)
    wants = [
        {i for i in range(len(rows)) if i not in (0, 1, 2)}, {3, 5, 7, 9, 10, 11, 12, 13}, {3, 5, 7, 9, 11, 12, 13}, {3, 5, 7, 9, 11, 12},
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wants, strict=True):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted((r["doc_id"] or 0, r["text"].lower()) for r in docs.collect())
        assert got == sorted((rows[i][0] or 0, rows[i][1].lower()) for i in want), name
        assert len(docs.columns) == 8
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert coded.count() == 6 and all(r["decoded_ok"] for r in coded.collect())


def test_executors_collect_before_a_stage(spark, monkeypatch):
    """Garbage in the executors' JVMs goes before each stage: full collections, besides those of the driver (left out here)."""
    monkeypatch.setattr(common, "swept", lambda spark: None)
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    common.ready(spark)
    assert full() > before  # those that cores ask for together count once


def test_exact_duplicates_with_many_partitions(spark, monkeypatch):
    """Tables between rounds have a few files a core, whatever the session's partitions; executors collect before each pass over texts."""
    root, rests = spark.conf.get("spark.checkpoint.dir"), []
    monkeypatch.setattr(exact_dedup, "rested", lambda spark: rests.append(set(os.listdir(root))), raising=False)
    rows = [(i, f"{i % 300:03} " + "same words " * 20 + f"{i % 150} end") for i in range(900)]
    many = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    were, there = {k: spark.conf.get(k) for k in many}, set(os.listdir(root))
    for k, v in many.items():
        spark.conf.set(k, v)
    try:
        got = exact_dedup.exact_duplicates(messy(spark, rows), first_digit=4, growth=3).collect()
        unique = exact_dedup.without_duplicates(messy(spark, rows), first_digit=4).count()
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got} == {(i, i % 300 + 600, 3, i >= 600) for i in range(900)} and unique == 300
    files = {t: sum(x.startswith("part-") for x in os.listdir(f"{root}/{t}")) for t in set(os.listdir(root)) - there}
    assert len(files) > 8 and max(files.values()) <= exact_dedup.FILES * spark.sparkContext.defaultParallelism
    assert rests[0] == there and len(rests) >= 2 * 4  # at the start, after the first digits, before each round, at the end
