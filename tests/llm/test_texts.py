"""Pseudonyms, page text, common subsequences and decontamination on small cases."""

import random

import pytest

from subsight.llm import decontaminate, html_text, lcs, pseudonyms
from subsight.llm.words import lower_words


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    f = pseudonyms.Feistel(b"k")
    image = [f.permute("t", i, size) for i in range(size)]
    assert sorted(image) == list(range(size))
    assert [f.permute("t", i, size, undo=True) for i in image] == list(range(size))


def test_pseudonyms_keep_formats():
    f = pseudonyms.Feistel(b"k")
    one = lambda t: pseudonyms.pseudonymise(t, f)[0]
    card = one("4495114827612972")
    assert card != "4495114827612972" and pseudonyms.luhn_digit(card[:-1]) == card[-1]
    assert one("card 4495 1148 2761 2972.") == f"card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}."
    assert one("1999-12-31")[:4] != "" and pseudonyms.pseudonymise("1999-12-31 and 31.12.1999", f)[1]["date"] == 2
    for same in ("room 12 of 3456", "4495114827612971", "1.2.3", "2021-02-30", "000-12-3456", 'token = "0641917ea4e9"', "", None):
        assert one(same) == same
    assert one("ehf.88@mail4.example.com").endswith("@mail4.example.com")
    assert one("GB82 WEST 1234 5698 7654 32")[:2] == "GB"


def test_pseudonyms_over_rows(spark):
    rows = [(1, "ip 17.57.238.115", "x"), (2, "again 17.57.238.115 " + "w " * 90_000, "x"), (3, None, None), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = {r.doc_id: r for r in pseudonyms.replace_personal_data(df, b"k").collect()}
    assert got[1].text.split()[1] == got[2].text.split()[1] != "17.57.238.115"
    assert got[1].found == {"ip": 1} and got[3].text is None and got[4].text == ""
    assert pseudonyms.replace_personal_data(df.limit(0), b"k").count() == 0


@pytest.mark.parametrize("cells", [1 << 26, 40])
def test_lcs_against_table(monkeypatch, cells):
    monkeypatch.setattr(lcs, "CELLS", cells)
    rng = random.Random(4)
    for _ in range(400):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        taken = lcs.aligned(a, b)
        rest = iter(b)
        assert len(taken) == table[-1][-1] == lcs.lcs_length(a, lcs.masks_of(b), len(b))
        assert taken == sorted(set(taken)) and all(a[i] in rest for i in taken)


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav>"
    '<div class="ad">Buy</div>%s<footer>&copy; me</footer></body></html>'
)


def test_page_text(spark):
    article = '<article><h1>A &amp; B&amp</h1><p><b>one<br>two<p>th<i>r</i>ee\n x</p><script>var t="</p>";</script><section class="comments">no</section></article>'
    plain = "<p>Shared head</p><p>%s</p><p>Shared foot</p>"
    pages = [
        (1, "http://h/a/1", PAGE % article),
        (2, "http://h/a/2", PAGE % article),
        (3, "http://g/b/1", PAGE % (plain % "own one")),
        (4, "http://g/b/2", PAGE % (plain % "own two")),
        (5, "http://g/b/3", None),
        (None, None, ""),
        (7, "http://k/1", PAGE % (plain % "alone")),
        (8, "http://m/1", "<article>" + "<p>w" * 20_000),
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df.coalesce(1).repartition(1)).collect()}
    assert got[1].text == got[2].text == "A & B& one two three x"
    assert got[5].text == got[None].text == "" and got[8].n_chars == 39_999
    assert got[7].text == "Shared head alone Shared foot"
    assert html_text.extract(df.limit(0)).count() == 0


def test_differencing_deletes_shared_lines():
    a, b = (html_text.page_lines(PAGE % f"<p>Shared head</p><p>own {n}</p><p>Shared foot</p>") for n in "ab")
    assert html_text.main_text(a, b) == ("own a", 2)
    assert html_text.main_text(a, a)[0] == "Shared head own a Shared foot"


def test_pages_with_an_article_are_differenced_too():
    """Shared lines beside the article count as furniture; those within it stand."""
    page = "<p>Shared head</p><article><p>own %s</p><p>Same in both</p></article><p>Shared foot</p>"
    a, b = (html_text.page_lines(PAGE % (page % n)) for n in "ab")
    assert html_text.main_text(a, b) == ("own a Same in both", 2)
    assert html_text.main_text(a, a) == ("own a Same in both", 0)
    assert html_text.main_text(a, None) == ("own a Same in both", 0)


def test_differencing_decides_on_lines_beside_an_article():
    page = "<p>Shared head</p><p>Title %s</p><article><p>own %s</p><p>Same in both</p></article><p>Shared foot</p>"
    a, b = (html_text.page_lines(PAGE % (page % (n, n))) for n in "ab")
    assert html_text.main_text(a, b) == ("Title a own a Same in both", 2)
    assert html_text.main_text(a, a) == html_text.main_text(a, []) == ("own a Same in both", 0)


def plain_texts(pages):
    """Each page against the nearest pages of its host that are no copies, by looking at all of them."""
    rows = sorted((u.split("/")[2], u.split("/", 3)[3], i, u, h) for i, u, h in pages)
    found = []
    for at, (host, path, i, url, page) in enumerate(rows):
        lines = html_text.page_lines(page)
        sides = [next((r for r in part if r[0] == host and r[4] != page), None) for part in (rows[:at][::-1], rows[at + 1 :])]
        near = [r for r in sides if r and html_text.page_lines(r[4]) not in ([], lines)]
        other = max(near, key=lambda r: html_text._common("/" + r[1], "/" + path), default=None)
        found.append((i, *html_text.main_text(lines, other and html_text.page_lines(other[4]))))
    return sorted(found)


def test_pages_are_paired_across_ranges_and_copies(spark, monkeypatch):
    rng = random.Random(4)
    pages = []
    for i in range(120):
        host, kind = f"h{rng.randrange(3)}", rng.randrange(4)
        own = f"<p>Head {rng.randrange(2)}</p><p>own {rng.choice([1, 1, 1, i])}</p><p>Foot</p>"
        page = "" if kind == 0 and i % 5 == 0 else PAGE % (f"<article><p>text {i}</p><p>Foot</p></article>{own}" if kind == 1 else own)
        pages.append((i, f"http://{host}/{rng.choice('abc')}/{i:03}", page + "<!-- same -->" * (i % 7 == 0)))
    pages += [(200 + i, f"http://h1/b/{50 + i // 9:03}", PAGE % "<p>Head 1</p><p>copy</p><p>Foot</p>") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    expected = plain_texts(pages)
    for size in (500, 40, 7, 1):
        monkeypatch.setattr(html_text, "PAGES_PER_RANGE", size)
        assert sorted((r.page_id, r.text, r.shared_lines) for r in html_text.extract(df).collect()) == expected
    # Every copy is differenced, and all alike.
    assert {(text, gone) for i, text, gone in expected if i >= 200} == {("copy", 2)}


def test_items_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "tra pel mon sik dor".split() for b in "ba ce di fo gu ha je".split()] + [f"n{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate((15, 20, 33, 40, 60, 64, 9, 90))}
    rows, planted = [], set()
    for d in range(120):
        words = text(rng.randrange(30, 600))
        if d % 3 == 0:
            i = d // 3 % len(items)
            item = list(items[i])
            if d % 2:  # a paraphrase: a word in six is another one
                item = [w if k % 6 else rng.choice(vocabulary) for k, w in enumerate(item)]
            at = rng.randrange(len(words))
            words[at:at] = item
            planted.add((d, i))
        rows.append((d, " ".join(words), "x"))
    rows += [(200, None, "x"), (201, "", "x"), (None, " ".join(items[3]), "x"), (202, " ".join(text(9000) + items[4]), "x"), (203, " ".join(items[0]), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()] + [(50, None, 1), (None, "a b c", 1), (51, "", 1)], "item_id long, text string, doc_id int")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_items(docs, benchmark).collect()}
    wanted = planted | {(None, 3), (202, 4), (203, 0)}
    assert found <= wanted and len(found) >= 0.9 * len(wanted)
    assert {(None, 3), (202, 4), (203, 0)} | {p for p in planted if p[0] % 2 == 0} <= found
    clean = decontaminate.without_contaminated(docs, benchmark)
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in found}
    assert clean.columns == docs.columns
    assert decontaminate.find_items(docs.limit(0), benchmark).count() == 0
    assert decontaminate.find_items(docs, benchmark.limit(0)).count() == 0


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_items(texts, items):
    """Best ``(share, answer share)`` per text and item over every window of one and a half passages."""
    best = {}
    for d, words in texts.items():
        for i, item in items.items():
            answer = item[-(len(item) // 3) :]
            width = decontaminate.passage_size(len(item)) * 3 // 2
            for at in range(max(1, len(words) - width + 1)):
                region = words[at : at + width]
                if len(set(region) & set(item)) < 0.3 * len(set(item)):
                    continue
                shares = longest_common(region, item) / len(item), longest_common(region, answer) / len(answer)
                if min(shares) >= 0.6:
                    best[d, i] = max(best.get((d, i), (0, 0)), shares)
    return best


def test_items_against_every_window(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "tra pel mon sik dor vun".split() for b in "ba ce di fo gu ha je ki".split()] + [f"n{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate((12, 16, 24, 30, 45))}
    texts = {d: text(rng.randrange(20, 90)) for d in range(60)}
    for d in range(0, 60, 2):
        item = list(items[d // 2 % 5])
        for k in rng.sample(range(len(item)), d % 5 * len(item) // 8):
            item[k] = rng.choice(vocabulary)
        at = rng.randrange(len(texts[d]))
        texts[d] = texts[d][:at] + item + texts[d][at:]
    wanted = brute_items(texts, items)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in texts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    rows = decontaminate.find_items(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id): r for r in rows}
    assert len(found) == len(rows) and found.keys() <= wanted.keys()
    assert len(found) >= 0.9 * len(wanted)
    assert all(r.item_share <= wanted[k][0] + 1e-9 for k, r in found.items())
    # Copies of texts and items give a row each, and items may come in any number of passes.
    monkeypatch.setattr(decontaminate, "ITEMS_PER_PASS", 2)
    monkeypatch.setattr(decontaminate, "ITEM_BYTES_PER_PASS", 100)
    again = decontaminate.find_items(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.item_share) for r in again} == {(r.doc_id, r.item_id, r.item_share) for r in rows}


def test_latent_space_is_fitted_on_every_passage_of_every_text(spark, monkeypatch):
    np, rng = decontaminate.np, random.Random(9)
    monkeypatch.setattr(decontaminate, "FIT_WORDS", 300)
    monkeypatch.setattr(decontaminate, "FIT_ROWS", 7)
    monkeypatch.setattr(decontaminate, "FEW", 4)
    lengths = (0, 1, 5, 8, 9, 40, 900)
    texts = [" ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(lengths[i % 7])) for i in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = decontaminate.term_table(docs, "doc_id")
    n, number, words = decontaminate.document_frequencies(table)
    raws = [r.terms for r in table.collect()]
    wanted = np.zeros(decontaminate.TERMS, dtype=int)
    for raw in raws:
        wanted[np.unique(decontaminate._terms(bytes(raw)))] += 1
    assert number == 70 and words == sum(map(len, raws)) // 4 and (n == wanted).all()
    idf = (np.log((1 + number) / (1 + n)) + 0.01).astype(np.float32)
    space = decontaminate.randomised_svd(table.selectExpr("terms", "1 + doc_id % 3 AS weight"), idf, 8)
    texts = [(decontaminate._terms(bytes(r.terms)), 1 + r.doc_id % 3) for r in table.collect()]
    every = [terms[at : at + 8] for terms, weight in texts for _ in range(weight) for at in range(0, len(terms), 8)]
    vectors = np.array([np.bincount(p, minlength=decontaminate.TERMS) * idf for p in every], dtype=np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    # 60 words span no more directions than the space has, so its answer is exact: left singular vectors.
    left = vectors @ space
    real = np.abs(space).max(axis=0) > 0
    assert real.sum() == np.linalg.matrix_rank(vectors, tol=1e-3) and len(every) > 1000
    assert np.abs(left[:, real].T @ left[:, real] - np.eye(real.sum())).max() < 1e-2


def test_word_hashes_tell_the_same_words_apart(monkeypatch):
    ids, rng = decontaminate._WordIds(), random.Random(3)
    edge, signs = decontaminate._EDGE, b"aAbZz09.,;-'\xc3\xa9 \t\n\x0b\x0c\r\x1f\x85"
    texts = [bytes(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(300)] + [None, b"", b" ", b"...", b"x", b"\0", b"\0\0"]
    wanted = [[w for w in (x.strip(edge) for x in lower_words(t)) if w] for t in texts]
    monkeypatch.setattr(decontaminate._WordIds, "AT_ONCE", 1000)
    found = list(ids.of_all(texts))
    assert len(found) == len(texts) and all((ids.of(t) == f).all() for t, f in zip(texts, found))
    known = {}
    for words, hashes in zip(wanted, found):
        assert len(words) == len(hashes)
        assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(known.values())) == len(known) > 1000


def test_search_is_the_same_in_any_blocks(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}".encode() for i in range(300)]
    ids = decontaminate._WordIds()
    text = lambda n: ids.of(b" ".join(rng.choice(words) for _ in range(n))).tobytes()
    items = [(i, text(n)) for i, n in enumerate((9, 20, 20, 33, 70))]
    texts = [text(n) for n in (0, 5, 300, 2000)] + [items[1][1] + text(40), text(17) + items[4][1], b"".join(r for _, r in items)]
    space = decontaminate.np.random.default_rng(1).standard_normal((decontaminate.TERMS, decontaminate.RANK)).astype("float32")
    whole = decontaminate.Searcher(space, items).find(texts)
    assert {m[0] for m in whole[-1]} == {0, 1, 2, 3, 4}
    for cells in (1, 7, 100):
        monkeypatch.setattr(decontaminate, "PRODUCT_CELLS", cells)
        cut = decontaminate.Searcher(space, items).find(texts)
        for a, b in zip(whole, cut):
            assert [(m[0], *m[2:]) for m in a] == [(m[0], *m[2:]) for m in b]
            assert [m[1] for m in a] == pytest.approx([m[1] for m in b], abs=1e-5)


def test_long_names_and_values_before_other_groups():
    from subsight.llm.pseudonyms import Feistel, pseudonymise

    feistel = Feistel(b"k")
    for size in (65, 4_000, 1_000_000):
        text, found = pseudonymise("a" * size + "@example.org", feistel)
        assert found["email"] == 1 and len(text) == size + 12 and text[:size] != "a" * size
    a, b = (pseudonymise("x" * 64 + c + "@example.org", feistel)[0] for c in "yz")
    assert a != b
    values = {"iban": ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], "card": ["4495114827612972", "4495 1148 2761 2972"]}
    for kind, forms in values.items():
        for value in forms:
            alone, found = pseudonymise(value, feistel)
            assert found[kind] == 1 and alone != value
            for before in ("", "no ", "(", "X: "):
                for after in ("", " EUR 50", " 12/27", " 123", " BIC COBADEFF", ".", ", 5", ")"):
                    text, found = pseudonymise(before + value + after, feistel)
                    assert (text, found[kind]) == (before + alone + after, 1), (before, value, after)


@pytest.mark.parametrize("page", ["<a " * 1_000_000, "<b>" * 20_000 + "</i>" * 20_000, "<!" * 500_000, "<a " * 200_000 + ">"])
def test_hostile_pages_take_seconds(page):
    import time

    from subsight.llm.html_text import page_lines

    start = time.perf_counter()
    page_lines(page)
    assert time.perf_counter() - start < 10


def test_letters_are_those_of_unicode():
    from subsight.llm.langid import has_letter

    assert not any(map(has_letter, [None, "", "12 _-", "² ½ ① Ⅷ"]))
    assert all(map(has_letter, ["a", "1é", "中", "ʰ", "ǅ"]))
