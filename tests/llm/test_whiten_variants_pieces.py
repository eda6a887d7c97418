"""Whitening, spelling variants and SentencePiece coding against brute force, exact arithmetic and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import pieces, pii, urls, variants, whiten

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- 11 whitening ---


def test_whitening_equals_exact_arithmetic(spark):
    rnd = random.Random(5)
    vectors = [[rnd.gauss(0, 3) + 2 * k for k in range(5)] for _ in range(60)]
    vectors += [vectors[0]] * 30
    rows = [(i, v, "x", 7) for i, v in enumerate(vectors)] + [(None, vectors[1], "x", 7)]
    rows += [(900, None, "x", 7), (901, [1.0, None, 1.0, 1.0, 1.0], "x", 7), (902, [1.0, float("nan"), 1.0, 1.0, 1.0], "x", 7), (903, [float("inf")] * 5, "x", 7), (904, [1.0, float("-inf"), 0.0, 0.0, 0.0], "x", 7)]
    out = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int"))
    got = out.collect()
    assert len(got) == 91 * 5 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in [*vectors, vectors[1]]]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert {r["n"] for r in got} == {n}
    dev = {i: sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for i, v in zip([*range(90), None], x, strict=True)}
    assert {(r["vec_id"], r["deviation"]) for r in got} == set(dev.items())
    v = np.array([[float(sum(Fraction(n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x) / n**3) for j in range(5)] for i in range(5)])
    e, basis = np.linalg.eigh(v)
    for k in range(1, 6):
        want = {i: float(sum((c - Fraction(t, n)) * Fraction(b) for c, t, b in zip(r, s, basis[:, -k], strict=True))) / e[-k] ** 0.5 for i, r in zip([*range(90), None], x, strict=True)}
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k}
        sign = 1 if mine[3] * want[3] > 0 else -1
        assert all(abs(mine[i] * sign - want[i]) < 1e-9 for i in want)
        assert {round(r["explained"], 12) for r in got if r["component"] == k} == {round(float(e[-k] / np.trace(v)), 12)}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_squares_are_exact_for_large_numbers(spark):
    rnd = random.Random(2)
    x = [[rnd.randrange(-(2**40), 2**40) for _ in range(3)] for _ in range(50)]
    whole = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, x array<long>").repartition(3)
    n, s = whiten.sums(whole)
    assert s == [sum(c) for c in zip(*x, strict=True)]
    found = whiten.squares(whole, n, s)
    z = [[n * c - t for c, t in zip(v, s, strict=True)] for v in x]
    assert found == {(i, j): sum((v[i] + (v[j] if j > i else 0)) ** 2 for v in z) for i in range(3) for j in range(i, 3)}


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]):
        assert whiten.whiten(spark.createDataFrame(rows, schema)).collect() == []
    flat = whiten.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9), r["explained"]) for r in flat) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    with pytest.raises(ValueError, match="entries"):
        whiten.whiten(spark.createDataFrame([(1, [0.0]), (2, [1.0, 1.0])], schema))


def test_whitening_query(spark):
    out = whiten.op11_whiten(spark, SF)
    one = out.agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("ids"), F.max("component").alias("k"), F.max("identity_error").alias("error")).first()
    assert one["rows"] == one["ids"] * one["k"] and one["k"] == 32 and one["error"] < 1e-6


# --- 12 variants ---


def near(a, b):
    """One edit apart, by trying all of them."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    n = Counter()
    for doc_id, text in docs:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    words = sorted(w for w in n if n[w] >= 2)
    out = {}
    for w in words:
        by = sorted((x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)), key=lambda x: (-n[x], x))
        form = by[0] if by and n[by[0]] >= 10 * n[w] else None
        out[w] = (form, n[w], len(by), n[form] if form else None)
    rows = set()
    for w, (form, k, m, f) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, k, m, f))
    return rows


def spelled(seed=3):
    rnd = random.Random(seed)
    stems = ["interest", "interested", "überprüfen", "ÀÉÎõü×÷àé", "aaaaaaaa", "abababab", "mississippi"] + ["".join(rnd.choice("abc") for _ in range(rnd.randint(7, 14))) for _ in range(60)]
    words = []
    for k, w in enumerate(stems):
        words += [w] * (300 if k % 3 else 3)
        for _ in range(6):
            i = rnd.randrange(len(w))
            words += [rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice("abé") + w[i:], w[:i] + rnd.choice("abz") + w[i + 1 :]])] * rnd.choice([2, 2, 20])
    rnd.shuffle(words)
    docs = [(i, " ".join(words[i::40])) for i in range(40)]
    return docs + [(7, docs[7][1]), (None, "Interest interest NULLWORD nullword nullword"), (50, None), (51, ""), (52, "x" * 30_000 + " " + "x" * 30_000 + " " + "x" * 29_999 + "," + "x" * 29_999)]


@pytest.mark.parametrize("crowd", [256, 6])
def test_variants_equal_brute_force(spark, crowd):
    docs = spelled()
    rows = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    out = variants.variants(rows, crowd=crowd)
    got = [tuple(r) for r in out.collect()]
    want = brute_variants(docs)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in want) > 50 and sum(r[1] is not None and r[2] != r[1] for r in want) > 0
    assert variants.variants(rows.limit(0)).collect() == []


def test_crowded_groups_are_split_to_the_end(spark):
    """Words that share all but one letter, and a group of one first half: no group beyond the bound but those of one place."""
    words = [f"prefix{a}{b}{c}ending" for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"]
    rows = spark.createDataFrame([(w, 2 + k) for k, w in enumerate(words)], "word string, n long")
    sizes = [r[0] for r in variants.groups(rows, 4).select(F.size("members")).collect()]
    assert max(sizes) <= 9
    got = [(r["word"], r["near"]) for r in variants.near_words(rows, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if near(a, b)}


def test_roots_of_a_chain(spark):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(11)], "word string, form string")
    assert {r["root"] for r in variants.roots(links).collect()} == {"11"}
    assert variants.roots(links.limit(0)).count() == 0


def test_variants_query_equals_sql(spark):
    from compare import compare, connect

    assert compare(variants.op12_variants(spark, SF), connect(SF), variants.OP12_SQL) is None


# --- 13 pieces ---


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return pieces.Coder(file.read(), keep=500)


def odd_texts():
    rnd = random.Random(1)
    texts = ["", " ", "  ", "a", "▁", "▁▁a  b", "\n\n   x", " " * 40, " " * 1000 + "the" + " " * 17 + "z", "\x00é퟿😀 日本語テキスト", "aaaaaaabaaaa" * 300, "ab" * 999, " ̀x", "x" * 100_000, " " * 50_000]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(20_000)), "".join(rnd.choice("etaoin shrdlu▁") for _ in range(30_000))]
    for _ in range(300):
        letters = rnd.choice(["ab", "the ", "etaoinsr", "abc日本 é😀", "0123 .,-", "==== ####\n\n\t", "▁ a", "ing ed tion er"])
        texts.append("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))))
    return texts


def test_pieces_equal_the_library(coder, library):
    texts = odd_texts()
    want = library.encode(texts, num_threads=1)
    assert coder.encode(texts) == want and coder.encode(texts[::-1]) == want[::-1]
    assert [coder.decode(ids) for ids in want] == [library.decode(ids) for ids in want] == [t.replace("▁", " ") for t in texts]


def test_any_ids_decode_as_in_the_library(coder, library):
    rnd = random.Random(4)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32_000), rnd.randrange(260)]) for _ in range(rnd.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids)


def test_pieces_of_tables(spark, library):
    texts = [None, "", "Hello  wörld", "Hello  wörld", "a\nb"]
    docs = spark.createDataFrame([(i if i != 4 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    ids = pieces.encode(docs)
    assert sorted(((r["doc_id"], r["ids"]) for r in ids.collect()), key=str) == sorted(((i if i != 4 else None, library.encode(t or "")) for i, t in enumerate(texts)), key=str)
    assert sorted(r["text"] for r in pieces.decode(ids).collect()) == sorted(t or "" for t in texts)
    assert pieces.digests(docs.limit(0)).count() == 0


def test_pieces_query(spark, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {tuple(r) for r in pieces.op13_pieces(spark, SF).collect()}
    want = set()
    for i, t in rows.items():
        ids = library.encode(t)
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want


def test_other_models_are_refused():
    for data in (b"", b"\x0a\x03\x0a\x01a", b"\x12\x02\x18\x01"):
        with pytest.raises(ValueError, match="models"):
            pieces.Model(data)


# --- 5 and 8 on names that their lists don't hold ---

#: None of these is in a gazetteer.
OTHER_GIVEN = "Oluwaseun Priya Jiro Kateryna Milos Ingeborg Siobhan Thabo Yusuf Aylin Bogdan Chidi Dagny Eero Fatoumata Giulia Hyun Ivana Kwame Leocadia".split()
OTHER_FAMILY = "Adeyemi Raghunathan Tanaka Shevchenko Novak Haugen Gallagher Mokoena Demir Yilmaz Popescu Okafor Lindqvist Virtanen Diallo Bianchi Kowalski Horvat Mensah Ferreira".split()
OTHER_AREAS = ["231", "331", "531", "636", "928"]


def planted_strangers(seed, n):
    """Texts with names and numbers that only context and shape give away, and capitalised look-alikes."""
    rng = random.Random(seed)
    pick, digit = rng.choice, lambda k: "".join(rng.choices("0123456789", k=k))
    yes = {
        "named": lambda: (pick(["signed", "Mr.", "patient", "contact", "name:", "Dr."]), f"{pick(OTHER_GIVEN)} {pick(OTHER_FAMILY)}"),
        "initial": lambda: (pick(["name:", "Dr.", "contact", "with"]), f"{pick(OTHER_GIVEN)} {pick('ABCD')}. {pick(OTHER_FAMILY)}"),
        "social": lambda: (pick(["my ssn is", "social security", "SSN:", "they gave"]), f"{rng.randrange(100, 665)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"),
        "phone": lambda: (pick(["call", "phone:", "reach us on", "mobile"]), f"({pick(OTHER_AREAS)}) {rng.randrange(200, 999)}-{digit(4)}"),
    }
    no = [
        lambda: (pick(["on", "since", "version", "dated"]), f"{rng.randrange(1950, 2030)}-{rng.randrange(10, 12)}-{rng.randrange(10, 28)}"),
        lambda: (pick(["isbn", "order", "total", "about"]), f"{rng.randrange(10, 99)} {digit(3)} {digit(3)}"),
        lambda: (pick(["near", "in", "to", "the"]), pick(["Porto Alegre", "Cold Harbour", "Silver Dragon", "Elm Crescent", "Golden Gate"])),
        lambda: (pick(["the", "a", "our"]), pick(["Annual Report", "Data Protection", "Quality Control", "Blue Whale", "Supreme Being"])),
        lambda: (pick(["on", "every"]), pick(["Monday Morning", "Friday Night"])),
    ]
    texts, wanted = [], []
    for _ in range(n):
        text, spans = "", set()
        for _ in range(rng.randrange(4)):
            kind = pick(list(yes)) if rng.random() < 0.3 else None
            before, match = yes[kind]() if kind else pick(no)()
            text += before + " "
            if kind:
                spans.add((len(text), len(text) + len(match), kind))
            text += match + pick([" and so on ", ". ", ", they said "])
        texts.append(text)
        wanted.append(spans)
    return texts, wanted


def test_names_and_numbers_outside_the_lists(spark):
    assert not set(OTHER_GIVEN) & set(pii.GIVEN) and not set(OTHER_FAMILY) & set(pii.FAMILY) and not set(OTHER_AREAS) & set(pii.AREAS)
    docs = lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train_spans(docs(planted_strangers(1, 1500)[0]))
    texts, wanted = planted_strangers(2, 800)
    found = {r["doc_id"]: {(s["start"], s["end"]) for s in r["added"]} for r in pii.find_pii(docs(texts), model).collect()}
    hit, n = Counter(), Counter()
    for i, spans in enumerate(wanted):
        for a, b, kind in spans:
            n[kind] += 1
            hit[kind] += (a, b) in found[i]
    assert all(hit[k] >= 0.8 * n[k] for k in n) and len(n) == 4
    right = sum(len(found[i] & {(a, b) for a, b, _ in w}) for i, w in enumerate(wanted))
    assert right >= 0.9 * sum(map(len, found.values()))


def test_added_spans_overlap_no_base_span(spark):
    """Against a plain test of all pairs, with many spans of several kinds in a text."""
    rng = random.Random(7)
    parts = ["4111 1111 1111 1111", "Anna Keller", "+49 30 1234567", "555-12-1234", "1.2.3.4", "a@b.co", "(212) 555-0199", "and", "4111 1111", "79927398713 12", "Mr. Paul Meyer"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.train_spans(docs)
    got = {r["doc_id"]: r for r in pii.find_pii(docs, model).collect()}
    every = {r["doc_id"]: r for r in pii.with_spans(docs, F.col("text"), model).select("row.doc_id", *pii.KINDS, "added").collect()}
    taken = {r["doc_id"]: [c for k in pii.CANDIDATES for c in r[k]] for r in docs.select("doc_id", *[pii.marked(F.col("text"), p, pii.GATES[k]).alias(k) for k, p in pii.CANDIDATES.items()]).select("doc_id", *[F.filter(pii._candidates(F.col(k), k), pii._taken(model, k)).alias(k) for k in pii.CANDIDATES]).collect()}
    for i in got:
        base = [s for k in pii.KINDS for s in every[i][k]]
        want = {(c["kind"], c["start"], c["end"]) for c in taken[i] if not any(s["start"] < c["end"] and c["start"] < s["end"] for s in base)}
        assert {(c["kind"], c["start"], c["end"]) for c in got[i]["added"]} == want
    assert any(len(taken[i]) > len(got[i]["added"]) for i in got)


def test_url_verdicts_of_ordinary_and_telling_sites(spark):
    ordinary = ["the-weekly-thread", "northern-lights", "thistle-and-thorn", "athens-today", "rather-good-tea", "fourth-edition", "old-town-hall", "riverbank"]
    telling = ["viagra-pills-now", "casino-bonus-spins", "xxx-adult-videos", "spam-backlink-farm"]
    rows = [(i, f"https://{site}.example.{end}/page/{i}") for i, (site, end) in enumerate((s, e) for s in ordinary + telling for e in ("com", "net", "org"))]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    n = 3 * len(ordinary)
    assert [got[i] for i in range(n)].count("block") <= 1 and all(got[i] == "block" for i in range(n, len(rows)))
