"""Operators against plain Python twins, and what their methods promise on made-up tables."""

import collections
import hashlib
import html as markup
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tests.llm import odd
from tests.llm.test_operators import brute_near
from tidemark.llm import decontamination, exact_dedup, html_text, language_id, near_dedup, packing, pii, queries, substring_dedup

SF = "/root/testdata/sf0.01"


# pages: a twin on well-formed markup, by the standard library's parser

_INLINE = {"b", "i", "a", "span", "em", "br"}


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = ["root", "", []]
        self.open = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attributes):
        node = [tag, dict(attributes).get("class", ""), []]
        self.open[-1][2].append(node)
        if tag != "br":
            self.open.append(node)

    def handle_endtag(self, tag):
        while len(self.open) > 1 and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _plain(node, gone=frozenset()):
    if isinstance(node, str):
        return node
    if _shape(node) in gone:
        return " "
    inner = "".join(_plain(c, gone) for c in node[2])
    return inner if node[0] in _INLINE and node[0] != "br" else f" {inner} "


def _shape(node):
    return " ".join(node.split()) if isinstance(node, str) else (node[0], node[1], tuple(_shape(c) for c in node[2]))


def _blocks(node, out):
    for c in node[2]:
        if not isinstance(c, str):
            if c[0] not in _INLINE and _plain(c).split():
                out.add(_shape(c))
            _blocks(c, out)
    return out


def _article(node):
    if isinstance(node, str):
        return None
    return node if node[0] == "article" else next((a for a in map(_article, node[2]) if a), None)


def twin(rows):
    """page_id to text, counting subtrees per host over distinct articles."""
    trees = {k: (url.split("://")[1].split("/")[0], Tree(page).top) for k, url, page in rows}
    body = {k: _article(t) or t for k, (_, t) in trees.items()}
    words = lambda node, gone=frozenset(): " ".join(_plain(node, gone).split())
    seen, articles = collections.defaultdict(set), collections.defaultdict(set)
    for k, (host, t) in trees.items():
        articles[host].add(words(body[k]))
        for s in _blocks(t, set()):
            seen[host, s].add(words(body[k]))
    out = {}
    for k, (host, t) in trees.items():
        gone = {s for (h, s), a in seen.items() if h == host and len(a) >= html_text.MIN_PAGES and len(a) >= html_text.MIN_SHARE * len(articles[h])}
        left, whole = words(body[k], gone), words(body[k])
        out[k] = whole if _article(t) and 2 * len(left) < len(whole) else left
    return out




def _pages(rng):
    rows = []
    for k in range(14):  # strips that no name gives away, beside the text
        rows.append((k, f"https://a.org/{k}", f"<div>All our offers of the week</div><div><p>{odd.words(rng, 30)}</p><p>{odd.words(rng, 9)}</p></div><p>Read on <b>now</b></p>"))
    for k in range(20, 34):  # and inside an article
        rows.append((k, f"https://b.org/{k}", f"<div>Home</div><article><h1>{odd.words(rng, 4)}</h1><p>Get the app today</p><p>{odd.words(rng, 40)} &amp; {odd.words(rng, 3)}</p><ul><li>Share</li><li>Print</li></ul></article>"))
    base = [odd.words(rng, 25) for _ in range(6)]
    for k in range(40, 52):  # near copies of one article aren't templates to each other
        parts = list(base)
        parts[k % 6] = odd.words(rng, 25)
        rows.append((k, f"https://c.org/{k}", "<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"))
    for k in range(60, 64):  # too few pages to tell
        rows.append((k, f"https://d.org/{k}", f"<div>All our offers of the week</div><p>{odd.words(rng, 20)}</p>"))
    return rows


def test_templates_change_texts_as_the_twin_says(spark):
    rows = _pages(random.Random(1))
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.text for k, r in got.items()} == twin(rows)
    assert all("offers" not in got[k].text and "Read on" not in got[k].text and got[k].templates >= 2 for k in range(14))
    assert all("app today" not in got[k].text and "Share" not in got[k].text and " & " in got[k].text for k in range(20, 34))
    assert all(len(got[k].text.split()) == 150 for k in range(40, 52)) and all("offers" in got[k].text for k in range(60, 64))


def test_counts_alone_clean_named_and_unnamed_strips(spark):
    rng = random.Random(2)
    body = {k: odd.words(rng, 30) for k in range(12)}
    rows = [(k, f"https://a.org/{k}", f"<nav><ul><li>One</li></ul></nav><div><p>{t}</p></div><footer>Imprint</footer>") for k, t in body.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df, by_name=False).collect()} == body


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a 'x", "<div>", "<script>", "</p>", '<a b=\'" ', "&", "<!--", "<li>"])
def test_broken_markup_is_read_in_linear_time(piece):
    page = piece * (1_000_000 // len(piece)) if piece not in ("<div>", "<li>", "</p>") else piece * 60_000
    began = time.time()
    root = html_text.parse(page)
    html_text.hash_subtrees(root)
    html_text.main_text(root)
    assert time.time() - began < 10  # a quadratic reader takes hours
    assert markup.unescape("&amp;") == "&"


# languages


def test_languages_of_rows_left_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.col("doc_id") % 2 == 1
    model = language_id.fit(docs.where(~held))
    rows = language_id.identify_documents(docs.where(held), model=model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 400 and sum(r.language == r.lang for r in rows) >= 0.98 * len(rows)


def test_evidence_of_pages_is_fused(spark):
    rng = random.Random(7)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    labelled = [(k, make("abcd" if k % 2 else "wxyz", 40), "de" if k % 2 else "es") for k in range(80)]
    model = language_id.fit(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    page = lambda text, lang: f"<html{f' lang={lang}' if lang else ''}><article><p>{text}</p></article></html>"
    rows = [(k, f"https://x{k % 2}.org/{k}", page(make("abcd" if k % 2 else "wxyz", 30), None)) for k in range(60)]
    rows += [
        (100, "https://new.net/1", page("m", "de-AT")), (101, "https://new.net/2", page("m", "es")), (102, "https://shop.de/", page("m", None)), (103, "https://shop.es/", page("m", None)),
        (104, "https://x1.org/a", page("m", None)), (105, "https://x0.org/a", page("m", None)),  # what the host's other pages say
        (106, "https://new.net/3", page(make("abcd", 40), "es")),  # the declaration lies
        (107, "https://new.net/4", page("qqq jjj vvv kkk " * 30, "de")), (108, None, None), (109, "https://new.net/5", page("123 456", "de")),
    ]
    got = {r.page_id: r for r in language_id.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert [got[k].language for k in range(100, 107)] == ["de", "es", "de", "es", "de", "es", "de"]
    assert got[100].declared == "de" and got[106].declared == "es" and got[106].text_language == "de"
    assert [got[k].reason for k in (107, 108, 109)] == ["foreign", "no letters", "no letters"] and not got[107].kept and got[106].kept
    assert len(got) == len(rows)


def test_documents_of_other_languages_are_dropped(spark):
    rng = random.Random(7)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(k, make("abcd" if k % 2 else "wxyz", 40), "aa" if k % 2 else "zz", "s") for k in range(80)] + [(100, make("klmnop", 60), None, "s"), (101, "12 34", None, "s"), (102, make("abcd", 30), None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in language_id.drop_foreign(docs).collect()} == {*range(80), 102}


# personal data: the permutation in plain Python


def _shift(text, mask, kind, key):
    chars = list(text)
    for r in range(pii.ROUNDS):
        rest = "\n".join(c if (i + r) % 2 == 0 else "" for i, c in enumerate(chars))
        pads = hashlib.sha512("|".join((key, kind, str(r), rest)).encode()).hexdigest()
        for i, m in enumerate(mask):
            alphabet = pii._ALPHABETS.get(m)
            if (i + r) % 2 and alphabet:
                chars[i] = alphabet[(alphabet.index(chars[i]) + int(pads[i * 4 % 128 :][:4], 16)) % len(alphabet)]
    return "".join(chars)


def _card(digits, key):
    v = digits[0] + _shift(digits[1:-1], "d" * (len(digits) - 2), "card", key)
    total = sum(sum(divmod(2 * int(c), 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(v)))
    return v + str(-total % 10)


def _account(packed, key):
    m = _shift(packed[4:], re.sub("[A-Z]", "u", re.sub("[0-9]", "d", packed[4:])), "account", key)
    number = "".join(str(int(c, 36)) for c in m + packed[:2] + "00")
    return f"{packed[:2]}{98 - int(number) % 97:02d}{m}"


def test_pseudonyms_equal_the_twin_in_every_notation(spark):
    card, iban = "4111111111111111", "GB82WEST12345698765432"
    notes = [
        "4111 1111 1111 1111", card, "4111-1111-1111-1111", "GB82 WEST 1234 5698 7654 32", iban, "+1 229-555-4838", "+1 (229) 555-4838", "(229) 555-4838", "229-555-4838", "229.555.4838", "+12295554838",
        "+44 20 7946 0958", "+442079460958", "+44 (20) 7946-0958", "Ann.Lee@example.com", "ann.lee@example.com", "ANN.LEE@example.com", "2021-03-04", "04.03.2021", "03/04/2021",
    ]
    df = spark.createDataFrame([(k, f"x {v} y") for k, v in enumerate(notes)], "doc_id long, text string")
    hidden = pii.pseudonymise(df, "key")
    got = [r.text[2:-2] for r in hidden.orderBy("doc_id").collect()]
    bare = [re.sub("[^0-9A-Za-z@]", "", x) for x in got]
    assert all(re.sub("[0-9A-Za-z]", "", a) == re.sub("[0-9A-Za-z]", "", b) for a, b in zip(got, notes))
    assert set(bare[:3]) == {_card(card, "key")} and set(bare[3:5]) == {_account(iban, "key")}
    phone = "2" + _shift("295554838", "d" * 9, "phone", "key")
    assert [b[-10:] for b in bare[5:11]] == [phone] * 6
    assert set(bare[11:14]) == {"442" + _shift("079460958", "d" * 9, "phone", "key")}
    local = _shift("ann.lee", "lllxlll", "email", "key")
    assert [g.split("@")[0].lower() for g in got[14:17]] == [local] * 3 and got[14][0].isupper() and got[14][1].islower() and got[16].split("@")[0] == local.upper()
    assert got[17] == "-".join(reversed(got[18].split("."))) and got[19].split("/") == [got[17][5:7], got[17][8:], got[17][:4]]
    back = [r.text[2:-2] for r in pii.pseudonymise(hidden, "key", reveal=True).orderBy("doc_id").collect()]
    assert back == notes


def test_pseudonyms_in_long_texts(spark):
    texts = ["a" * 1_500_000 + " 4111111111111111", ("word " * 300_000) + "ann@example.com\nline two\n+1 229-555-4838"]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert [r.n_values for r in rows] == [1, 2] and [len(r.text) for r in rows] == [len(t) for t in texts]


# packing


@pytest.mark.parametrize("parts", [1, 64, 211])
def test_sequences_are_full_whatever_the_partitions(spark, parts):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts)
    rows = packing.pack(docs, queries.TOKENIZER)
    by = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    r = by.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.max("end").alias("end"), F.count(F.when(F.col("n") != F.col("end"), 1)).alias("gaps")).first()
    assert r.end <= 2048 and r.gaps == 0 and r.tokens >= 0.995 * 2048 * r.sequences


# exact dedup


def test_most_documents_have_several_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    levels = exact_dedup.identities(docs).groupBy("level").count().collect()
    assert sum(r["count"] for r in levels if r.level > 0) > 0.5 * docs.count()


# near dedup


def test_near_groups_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, 2, 80)


# decontamination: a plain search for exact and re-parameterised items


def test_leaks_equal_a_plain_search(spark):
    rng = random.Random(12)
    items = {k: " ".join(odd.words(rng, 1) if j % 5 else str(rng.randint(2, 99)) for j in range(24)) for k in range(12)}
    other = lambda t: re.sub(r"\d+", lambda m: str(int(m[0]) + 100), t)
    docs, want = [], set()
    for k in range(120):
        body = odd.words(rng, 60).split()
        for j in rng.sample(sorted(items), rng.randint(0, 2)):
            made = rng.choice([items[j], other(items[j]), items[j].upper()]).split()
            if rng.random() < 0.3:
                made.insert(12, "inserted")
            body.insert(rng.randint(0, len(body)), " ".join(made))  # beside an item, not within it
            want.add((k, j))
        docs.append((k, " ".join(body)))
    template = lambda t: [("#" if w.isdigit() else w) for w in t.lower().split()]
    grams = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    plain = {(k, j) for k, t in docs for j, i in items.items() if 2 * len(grams(template(t)) & grams(template(i))) >= len(grams(template(i)))}
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(sorted(items.items()), "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= plain and want <= got, sorted(want - got)


def test_texts_that_share_an_id_are_searched_for_each(spark):
    sum_ = "What is the sum of 12 apples and 30 pears that the farmer counted before lunch"
    long_ = " ".join(odd.words(random.Random(4), 80).split())
    items = [(1, sum_), (1, long_), (1, sum_), (None, "Name the largest river that crosses the plain behind the old mill"), (None, "42"), (None, long_[:200]), (2, "short one")]
    docs = [(1, f"before {sum_} after"), (2, f"before {long_} after"), (3, "x\n42\ny"), (4, "so name the largest river that crosses the plain behind the old mill now"), (5, "Short one"), (6, "nothing of the kind")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = sorted((r.doc_id, -1 if r.item_id is None else r.item_id) for r in decontamination.find_leaks(*frames).collect())
    assert found == [(1, 1), (2, -1), (2, 1), (3, -1), (4, -1), (5, 2)]
    assert [r.doc_id for r in decontamination.drop_leaks(*frames).collect()] == [6]


def test_names_insertions_and_short_items(spark):
    items = [
        (1, "Tom has 5 red apples. Tom buys 3 more apples. Tom eats 2 apples. How many apples are left?"), (2, "too short"), (3, "42"), (4, "1 2 3 4 5 6 7 8"),
        (5, "the train from here runs for seven days over hills and rivers and then comes back to the town where it began its way"),
    ]
    docs = [
        (1, "Anna has 9 red apples. Anna buys 4 more apples. Anna eats 1 apples. How many apples are left?"), (2, "a\nToo short\nb"), (3, "it is too short here, 42 times"), (4, "1\n42\n2"),
        (5, "say the train from here runs for seven days over many hills and rivers and then comes back to the town where it began"), (6, " ".join(map(str, range(3000)))), (7, "x" * 1_200_000), (8, "word " * 250_000),
        (9, "Mary Ann has 9 red apples. Mary Ann buys 4 more apples. Mary Ann eats 1 apples. How many apples are left?"),
    ]
    found = decontamination.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (9, 1), (2, 2), (4, 3), (5, 5)}


# substrings


def test_the_first_document_by_id_keeps_a_passage(spark):
    rng = random.Random(3)
    passage = odd.words(rng, 60)
    rows = [(k, f"{odd.words(rng, 40)} {passage} {odd.words(rng, 40)}") for k in (9, 4, 7, 1, 6)] + [(None, f"{odd.words(rng, 40)} {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    results = []
    for parts in (1, 5):
        got = {r.doc_id: r for r in substring_dedup.drop_repeats(df.repartition(parts)).collect()}
        assert got[1].removed_words == 0 and got[1].repeated_words >= 40 and all(got[k].removed_words >= 40 for k in (4, 6, 7, 9, None))
        results.append({k: r.text for k, r in got.items()})
    assert results[0] == results[1]


def test_kept_texts_equal_a_plain_search(spark):
    """Chunks compared as texts, in loops: what stays of every document."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    cut = {}
    for r in docs.collect():
        raw = (r.text or "").encode()
        starts = [*substring_dedup.cut_points(np.frombuffer(raw, np.uint8))[0].tolist(), len(raw)]
        cut[r.doc_id] = [raw[a:b] for a, b in zip(starts, starts[1:])]
    places, first = collections.Counter(), {}
    for k in sorted(cut):
        for j, c in enumerate(cut[k]):
            places[c.rstrip()] += 1
            first.setdefault(c.rstrip(), (k, j))

    def runs(flags, chunks):
        out, at = [], 0
        while at < len(flags):
            end = at
            while end < len(flags) and flags[end]:
                end += 1
            if end > at and sum(len(c.decode().split()) for c in chunks[at:end]) >= substring_dedup.MIN_WORDS:
                out.append((at, end))
            at = end + 1 if end == at else end
        return out

    got = {r.doc_id: r.text for r in substring_dedup.drop_repeats(docs).collect()}
    changed = 0
    for k, chunks in cut.items():
        known = [places[c.rstrip()] > 1 for c in chunks]
        gone = set()
        for a, b in runs(known, chunks):
            later = [a <= j < b and known[j] and first[chunks[j].rstrip()] != (k, j) for j in range(len(chunks))]
            gone |= {j for x, y in runs(later, chunks) for j in range(x, y)}
        changed += bool(gone)
        assert got[k] == b"".join(c for j, c in enumerate(chunks) if j not in gone).decode(), k
    assert changed > 20


def test_names_count_as_whole_words():
    text = lambda page: html_text.main_text(html_text.parse(page))
    kept = ["ad-hoc", "related-work", "notice-of-award", "menu-engineering", "social-science", "promotion-law"]
    gone = ["ad", "top-ad", "ad-banner", "cookie-notice", "site-nav x", "share-links", "sidebar_left", "related", "ad-slot-3"]
    for name in kept:
        assert text(f'<body><h1>T</h1><div class="{name}"><p>kept words</p></div></body>') == "T kept words", name
        assert text(f'<body><h1>T</h1><div id="{name}"><p>kept words</p></div></body>') == "T kept words", name
    for name in gone:
        assert text(f'<body><p>a</p><div class="{name}"><p>gone words</p></div><p>b</p></body>') == "a b", name


def test_a_form_around_the_page_is_its_frame():
    text = lambda page: html_text.main_text(html_text.parse(page))
    assert text("<body><form><nav>menu</nav><h1>Title</h1><p>one</p></form></body>") == "Title one"
    assert text("<body><form><div><article><p>one</p><form><input><p>search</p></form></article></div></form></body>") == "one"
    assert text("<body><p>one</p><form><p>your mail</p></form></body>") == "one"
    assert text('<body><p>one</p><form class="newsletter"><h1>Subscribe</h1></form></body>') == "one"


def test_refusals(spark):
    from tidemark.llm.common import K1

    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies):
        with pytest.raises(ValueError, match="reserved"):
            drop(docs.withColumn(K1, F.lit(1)))
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_groups(docs, percent=50)
