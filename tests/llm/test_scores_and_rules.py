"""Toxicity, quality, surrogates and URL rules."""

import os
import re
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import quality, surrogate, toxicity, url_filter
from locusflow.llm.training import labels, sample_texts
from tests.llm import brute

D, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="needs the test tables")


def held_out_hits(spark, rows, label):
    truth = {r.doc_id: r[label] for r in labels(spark, LARGER).collect()}
    return [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]


@needs_data
def test_quality_query(spark):
    rows = quality.op9_quality(spark, LARGER).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    hits = held_out_hits(spark, rows, "quality")
    assert np.mean([a == b for a, b in hits]) >= 0.95


@needs_data
def test_toxicity_query(spark):
    rows = toxicity.op1_toxicity(spark, LARGER).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    hits = held_out_hits(spark, rows, "toxic")
    assert np.mean([a == b for a, b in hits]) >= 0.93


def test_trees_walk_like_plain_code():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 3] ** 2 > 1).astype(float)
    model = quality.train_boosted(x, y)
    z = []
    for row in x[:50]:
        total = model.start
        for f, t, v in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += v[node - (2**quality.DEPTH - 1)]
        z.append(total)
    assert model.score(x[:50]) == pytest.approx(1 / (1 + np.exp(-np.array(z))))
    assert np.mean((model.score(x) > 0.5) == y) > 0.95
    constant = quality.train_boosted(x[:0], y[:0]).score(x[:3])
    assert constant.tolist() == [0.5] * 3


def test_scores_of_awkward_rows(spark):
    docs = brute.frame(spark)
    marks = spark.createDataFrame([(1, 0, 0), (3, 1, 1), (None, 1, 1), (5, None, None), (7, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (
        quality.score_quality(docs, quality.learn(docs, marks, quality.train_rows())).select("doc_id", "text", "score").collect(),
        toxicity.score_toxicity(docs, toxicity.learn(docs, marks)).collect(),
    ):
        assert len(rows) == len(brute.TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null and empty alike
    none, nothing = brute.frame(spark, []), labels_of(spark)
    assert quality.score_quality(none, quality.learn(none, nothing, quality.train_rows())).count() == 0
    assert toxicity.score_toxicity(none, toxicity.learn(none, nothing)).count() == 0


def test_training_rows_are_bounded_by_id(spark):
    """One labelled id with very many rows gives one; clashing labels give none."""
    docs = brute.frame(spark, [(1, f"text {i % 50}", "s") for i in range(900)] + [(2, "two", "s"), (3, "three", "s")])
    marks = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (3, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = sample_texts(docs, marks, "quality", F.lit(True), 100).collect()
    assert sorted((r.doc_id, r.y) for r in rows) == [(1, 0), (2, 1)]
    assert len(sample_texts(docs, marks, "toxic", F.lit(True), 2).collect()) == 2


def labels_of(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model_of_idiots(spark):
    text = "the idiot and the moron met a loser near the trash while this worthless clown said good book too"
    return toxicity.language_model(brute.frame(spark, [(i, text, "s") for i in range(40)]))


@pytest.mark.parametrize(("noisy", "plain"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("tr@sh", "trash"), ("idioooot", "idiot"), ("l.o.s.e.r", "loser"), ("w0rth1e55", "worthless"), ("goooood", "good"), ("plain", "plain")])
def test_noisy_words_are_restored(model_of_idiots, noisy, plain):
    assert toxicity.Restorer(model_of_idiots).words(f"the {noisy}, said") >= {plain}


@pytest.mark.parametrize(("noisy", "plain"), [("h473", "hate"), ("d13", "die"), ("f4990t", "faggot"), ("k1!1", "kil"), ("a$$", "ass"), ("idio+", "idiot"), ("$7upid", "stupid"), ("kill!", "kill"), ("(die)", "die")])
def test_words_with_more_symbols_than_letters_are_restored(spark, noisy, plain):
    text = "they hate to die so kill the stupid idiot or that ass and faggot they all said"
    lm = toxicity.language_model(brute.frame(spark, [(i, text, "s") for i in range(40)]))
    assert plain in toxicity.Restorer(lm).words(f"the {noisy}, said")
    assert toxicity.Restorer(lm).token(f"{noisy},") == plain


def test_spaced_letters_are_joined(model_of_idiots):
    assert "idiot" in toxicity.Restorer(model_of_idiots).words("such an i d i o t here")


def test_long_and_short_runs_are_decoded(model_of_idiots):
    """No length is too long to decode, and three spaced letters are enough."""
    r = toxicity.Restorer(model_of_idiots)
    sentence = "the idiot and the moron met a loser near the trash while this worthless clown said good book too " * 20
    spaced = " ".join(sentence.replace(" ", ""))
    assert len(spaced) > 2000 and {"idiot", "moron"} <= r.words("well, " + spaced) and max(map(len, r.words(spaced))) < 40
    assert r.token("._.".join("w0rthle55" * 8)) == "worthless" * 8
    assert "too" in r.words("x; t o o") and "met" in r.words("they m e t")
    assert len(r.token("a" + "1" * 20_000)) < 20_001 and r.token("b" + "-" * 100_000) == "b"


def test_viterbi_finds_the_cheapest_reading(model_of_idiots):
    """Against all readings of the lattice."""
    lm = model_of_idiots

    def every(token, at=0):
        if at == len(token):
            yield "", 0.0
        else:
            for j, letters, price in toxicity.steps(token)[at]:
                for rest, cost in every(token, j):
                    yield letters + rest, price + cost

    def cost(read, price):
        s = [0, 0, *(0 if c == " " else int(toxicity.SYMBOL_OF[ord(c)]) for c in read), 0]
        return price + sum(lm[a, b, c] for a, b, c in zip(s, s[1:], s[2:], strict=False))

    for token in ("1d10t", "6o0d", "m.o.r.0.n", "looooser", "t h e"):
        best = min((cost(r, p), r) for r, p in every(token))
        got = toxicity.viterbi(token, lm)
        assert min(cost(r, p) for r, p in every(token) if r == got) == pytest.approx(best[0])


def test_restored_texts(spark, model_of_idiots):
    rows = toxicity.restore_texts(brute.frame(spark, [(1, "An 1D10T!", "s"), (2, None, "s"), (3, "", "s")]), model_of_idiots).collect()
    assert {r.doc_id: r.restored for r in rows} == {1: "an idiot", 2: None, 3: ""}


def test_permutations_keep_values_apart():
    for n in (1, 2, 3):
        plain = [f"{i:0{n}d}" for i in range(10**n)]
        assert sorted(surrogate.permute(p, "0123456789", "x", "t") for p in plain) == plain


@pytest.mark.parametrize(
    ("text", "shape"),
    [
        ("mail anna.b7@mail.example.com now", r"mail [a-z]{4}\.[a-z]\d@[a-z]{4}\.[a-z]{7}\.com now"),
        ("call +1 (310) 555-4510.", r"call \+1 \(\d{3}\) \d{3}-\d{4}\."),
        ("from 10.1.2.3 to", r"from \d+\.\d+\.\d+\.\d+ to"),
        ("card 4111 1111 1111 1111 ok", r"card \d{4} \d{4} \d{4} \d{4} ok"),
        ('token = "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"', r'token = "[0-9a-f]{40}"'),
        ("Frau Anna Schmidt kam", r"Frau [A-Z][a-z]+ [A-Z][a-z]{6} kam"),
    ],
)
def test_surrogates_keep_the_format(text, shape):
    new, n, _ = surrogate.replace(text, {})
    assert n == 1 and new != text and re.fullmatch(shape, new)
    assert surrogate.replace(text, {})[0] == new


def test_cards_keep_their_check_digit_and_names_their_gender():
    assert surrogate.luhn(surrogate.surrogate_of("card", "4111111111111111"))
    women, men = surrogate.GIVEN[:2]
    given = lambda text: surrogate.replace(text, {})[0].split()[1]
    assert given("Dr Anna Berg") in women and given("Dr Paul Berg") in men
    assert all(x in women for x in given("Mrs Marie-Claude Berg").split("-"))
    assert re.fullmatch(f"(?i:({'|'.join(men)})+)", given("Mr Jonathan Smith")) and re.fullmatch("[A-Z][a-z]+", given("Mr Jonathan Smith"))
    assert re.fullmatch("Dr [А-ЯЁ][а-яё]+ [А-ЯЁ][а-яё]+", surrogate.replace("Dr Иван Петров", {})[0])


def test_mentions_of_one_person_stay_together():
    """A surname has one surrogate, alone and with given names; a given name has one too."""
    text, n, k = surrogate.replace("Mr John Smith met Mr Smith, Mrs Anna Smith and Dr John Berg", {})
    m = re.fullmatch(r"Mr (\S+) (\S+) met Mr (\S+), Mrs (\S+) (\S+) and Dr (\S+) (\S+)", text).groups()
    assert m[1] == m[2] == m[4] != m[6] and m[0] == m[5] != m[3] and (n, k) == (4, 2)


@pytest.mark.parametrize(
    ("text", "shape", "mentions"),
    [
        ("John Smith wrote to Peter Jones", r"[A-Z][a-z]+ [A-Z][a-z]{4} wrote to [A-Z][a-z]+ [A-Z][a-z]{4}", 2),
        ("Mr van der Berg came", r"Mr van der [A-Z][a-z]{3} came", 1),
        ("Herr Ludwig van Beethoven kam", r"Herr [A-Z][a-z]+ van [A-Z][a-z]{8} kam", 1),
        ("then MR SMITH left", r"then MR [A-Z]{5} left", 1),
        ("Mr O'Brien and O'Brien's dog", r"Mr [A-Z]'([A-Z])([a-z]{4}) and [A-Z]'\1\2's dog", 2),
        ("Dr Jean-Luc Picard", r"Dr [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]{5}", 1),
        ("Frau Müller-Lüdenscheidt kam", r"Frau [A-Z]\w{5}-[A-Z]\w{11} kam", 1),
        ("Mr Jonathan Smith came. Mr. Jonathan sat; so did Jonathan", r"Mr ([A-Z][a-z]+) [A-Z][a-z]{4} came. Mr. \1 sat; so did \1", 3),
        ("Mr John Smith came, John Smith sat, Smith left", r"Mr ([A-Z][a-z]+) ([A-Z][a-z]{4}) came, \1 \2 sat, \2 left", 3),
        ("MS Windows, 12 Jan Monday, Mr and Mrs", None, 0),
    ],
)
def test_names_are_replaced_whole(text, shape, mentions):
    new, n, _ = surrogate.replace(text, {})
    assert n == mentions and (re.fullmatch(shape, new) if shape else new == text), new
    kept = {w for w in re.findall(r"\w+", text) if w in re.findall(r"\w+", new)}
    assert not kept & set("John Smith Jones Berg Ludwig Beethoven SMITH Brien Jean Luc Picard Müller Lüdenscheidt Jonathan".split())


def test_many_names_in_a_long_text():
    text = " ".join(f"Mr Jonathan Smith{'abcdefghij'[i % 10]} met ann{i}@mail.example.com and Smitha." for i in range(20_000))
    new, n, k = surrogate.replace(text, {})
    assert n == 60_000 and k == 20_010 and "Smith" not in new and "Jonathan" not in new


def test_account_numbers_and_addresses_keep_their_kind():
    for iban in ("de89370400440532013000", "gb82west12345698765432", "fr1420041010050500013m02606"):
        assert surrogate.mod_97(iban) == 1 == surrogate.mod_97(surrogate.surrogate_of("iban", iban)) and surrogate.surrogate_of("iban", iban) != iban
        assert surrogate.mod_97(surrogate.surrogate_of("iban", iban, surrogate.ROUNDS + 1)) == 1
    assert surrogate.mod_97(surrogate.surrogate_of("iban", "de00370400440532013000")) != 1
    private = {f"192.168.{a}.{b}": None for a in range(4) for b in range(0, 256, 5)}
    new = [surrogate.surrogate_of("ip", x) for x in private]
    assert len(set(new)) == len(new) and all(x.startswith("192.168.") for x in new)
    assert surrogate.surrogate_of("ip", "10.0.0.1").startswith("10.") and 16 <= int(surrogate.surrogate_of("ip", "172.20.1.1").split(".")[1]) < 32
    public = [surrogate.surrogate_of("ip", f"8.8.{a}.{b}") for a in range(8) for b in range(0, 256, 3)]
    assert len(set(public)) == len(public) and not any(x.startswith(("10.", "127.", "192.168.")) for x in public)


def test_another_key_gives_other_surrogates(spark):
    docs = brute.frame(spark, [(1, "mail to ann.b@mail.example.com please", "s")])
    a, b = (surrogate.surrogate_documents(docs, key=k).first().text for k in (b"one", b"two"))
    assert a != b and a == surrogate.surrogate_documents(docs, key=b"one").first().text


def test_taken_surrogates_get_a_further_try(spark):
    """The surrogate of the first address is itself an entity of the corpus."""
    first = "ab@mail.example.com"
    second = surrogate.surrogate_of("email", first)
    docs = brute.frame(spark, [(1, f"to {first}", "s"), (2, f"or {second} or {first}", "s"), (3, None, None), (None, "", None)])
    for limit in (surrogate.BROADCAST_FIXES, 0):
        out = {r.doc_id: r for r in surrogate.surrogate_documents(docs, limit).collect()}
        one, (a, b) = out[1].text.split()[1], out[2].text.split()[1::2]
        assert one == b != a and not {one, a} & {first, second}
        assert (out[2].n_mentions, out[2].n_entities, out[3].text, out[None].text) == (2, 2, None, "")


def test_no_surrogate_stays_taken(spark):
    """Names of scripts without groups are replaced, and a full space of short names goes over to longer ones."""
    for name in ("王伟", "محمد", "דוד", "राम", "김철수", "გიორგი", "öß", "ß"):
        assert surrogate.surrogate_of("name", name, surrogate.ROUNDS + 1) != name
    assert all(surrogate.surrogate_of("name", n) != n for n in ("王伟", "محمد", "דוד", "김철수", "გიორგი"))
    names = [a + b for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiou"] + ["王伟", "გიორგი", "김철수"]
    docs = brute.frame(spark, [(i, f"then Dr {n.title()} came", "s") for i, n in enumerate(names)] + [(999, "password=--------- ok", "s")])
    before = {n for r in docs.collect() for a, b, k in surrogate.entities(r.text) for n in [surrogate.normal(k, r.text[a:b])]}
    rows = surrogate.surrogate_documents(docs).collect()
    new = [r.text.split("Dr ")[1].split(" ")[0].lower() if "Dr" in r.text else r.text.split("=")[1].split(" ")[0] for r in rows if r.n_mentions]
    assert len(set(new)) == len(new) == 109 and not set(new) & before
    card = surrogate.surrogate_of("card", "4111111111111111", surrogate.ROUNDS + 1)
    assert len(card) > 16 and surrogate.luhn(card)
    assert surrogate.redress("card", "4111 1111 1111 1111", card).replace(" ", "") == card


@needs_data
def test_surrogate_query(spark):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    found = lambda texts: {(k, surrogate.normal(k, t[a:b])) for t in texts for a, b, k in surrogate.entities(t)}
    rows = surrogate.op3_surrogates(spark, LARGER).collect()
    tries = plain_tries({(k, surrogate.normal(k, t[a:b])) for t in before.values() for a, b, k in surrogate.entities(t)})
    assert {r.doc_id: (r.text, r.n_mentions, r.n_entities) for r in rows} == {i: surrogate.replace(t, tries) for i, t in before.items()}
    assert len(rows) == len(before) and all((r.text == before[r.doc_id]) == (r.n_mentions == 0) for r in rows)
    real, new = found(before.values()), found(r.text for r in rows)
    named = {x for x in new if not x[0].startswith("given")}
    assert not real & named and len(named) == len({x for x in real if not x[0].startswith("given")}) > 50


def plain_tries(values):
    """Attempts by going through all entities again and again until no surrogate is taken."""
    tries = dict.fromkeys(values, 0)
    while True:
        owner, bad = {}, set()
        for k, v in sorted(values):
            new = (k, surrogate.surrogate_of(k, v, tries[k, v]))
            if new in owner or new in values and k not in ("given0", "given1"):
                bad.add((k, v))
            owner.setdefault(new, v)
        if not bad:
            return tries
        for x in bad:
            tries[x] += 1


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = host.translate(brute.UPPER)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.LISTED if ("." + host).endswith("." + h) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


@needs_data
def test_url_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    rows = url_filter.op6_url_filter(spark, LARGER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = plain_verdict(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined else "allow"))


def test_awkward_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.NET", "https://example.net/en/x?y#z", "ftp://a.b.example.com/de/", "://net/", "x://net?q", "a://b://net/", "https://notnet/", "s://fr.org/fr", "s://org/fr/", "http://x.org/fr/\n?", "http://example.net/en/x?y#z"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] + [(None, urls[4], None), (4, urls[4], None)], "page_id long, url string, rule string")
    listed = spark.createDataFrame(list(url_filter.LISTED), "verdict string, host string, path string")
    rows = url_filter.judge_urls(pages, listed, url_filter.mine_rules(spark.createDataFrame([], "url string, bad boolean"))).collect()
    assert len(rows) == len(urls) + 2
    for r in rows:
        host, path, rule, verdict = plain_verdict(urls[4 if r.page_id is None else r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert url_filter.judge_urls(pages.limit(0), listed, url_filter.mine_rules(spark.createDataFrame([], "url string, bad boolean"))).count() == 0


def test_rules_are_mined_pruned_and_matched(spark):
    rows = [(f"http://shop{i}.bad.example/buy/{i}?ref=1", True) for i in range(20)] + [(f"http://site{i}.good.example/read/{i}", False) for i in range(60)]
    mined = url_filter.mine_rules(spark.createDataFrame([*rows, (None, True), ("http://x.y/z", None)], "url string, bad boolean"))
    rules = {tuple(r.tokens) for r in mined.collect()}
    assert ("h:bad",) in rules and all(len(t) == 1 for t in rules)
    urls = spark.createDataFrame([("http://new.bad.example/",), ("http://new.good.example/read/1",)], "url string")
    hit = {r.url for r in url_filter.matched_rules(urls, mined).collect()}
    assert hit == {"http://new.bad.example/"}


def test_small_bad_hosts_of_large_tables_and_common_bad_pages(spark):
    """Eight pages suffice beside 12,000 others, and rules remain where bad pages are the most."""
    small = [(f"http://small.example/{'x/' * (i % 3)}", True) for i in range(8)]
    clean = [(f"http://c{i % 50}.fine.test/read/{i}", False) for i in range(12_000)]
    rules = {tuple(r.tokens) for r in url_filter.mine_rules(spark.createDataFrame(small + clean, "url string, bad boolean")).collect()}
    assert ("d:small.example",) in rules and ("h:fine",) not in rules
    hot = [(f"http://hot.bad.example/{i}?a=1", True) for i in range(300)]
    rules = {tuple(r.tokens) for r in url_filter.mine_rules(spark.createDataFrame(hot + clean[:100], "url string, bad boolean")).collect()}
    assert ("h:bad",) in rules and ("s:http",) not in rules
    pages = spark.createDataFrame([(i, f"http://casino.example/{i}") for i in range(20)] + [(i, f"http://c{i}.fine.test/") for i in range(20, 60)], "page_id long, url string")
    rules = {tuple(r.tokens) for r in url_filter.mine_rules(url_filter.contrasted(pages, labels_of(spark))).collect()}
    assert ("h:casino",) in rules and ("s:http",) not in rules


def test_rules_of_tokens_that_go_together(spark):
    """Twenty-five tokens of the same pages, among them a clean one, would be 2^25 patterns; each alone is a rule."""
    path = "/".join(f"seg{chr(97 + i)}" for i in range(25))
    rows = [(f"http://x.example/{path}", i > 0) for i in range(30)] + [(f"http://y{i}.test/", False) for i in range(60)]
    rules = {tuple(r.tokens) for r in url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert all(len(t) == 1 for t in rules) and {("p:sega",), ("p:segy",), ("d:x.example",)} <= rules


def test_seed_words_and_labels(spark):
    pages = spark.createDataFrame([(1, "http://m.casino-win.example/x"), (2, "http://plain.example/"), (3, "http://other.example/"), (4, "http://broadcast.example/bets"), (None, None)], "page_id long, url string")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = {(r.url, r.bad) for r in url_filter.labelled_urls(pages, marks).collect()}
    assert got == {("http://m.casino-win.example/x", True), ("http://plain.example/", True), ("http://other.example/", True)}


def pages_of(groups, bad, n, start=0):
    """``n`` pages with all query keys of ``groups``, each on a host of its own."""
    return [(f"http://h{'abcdefghij'[i % 10]}{i + start}.test/?" + "&".join(f"{k}=1" for g in groups for k in g), bad) for i in range(n)]


def test_rules_of_several_classes_are_one_rule(spark):
    """Three classes of forty keys, bad only together: one rule, not 64,000, and it decides verdicts that no single token does."""
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    rows = pages_of((a, b, c), True, 30) + pages_of((a, b), False, 40, 100) + pages_of((a, c), False, 40, 200) + pages_of((b, c), False, 40, 300)
    mined = url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"))
    rules = {r.rule: r for r in mined.collect()}
    assert len(rules) == 1 and mined.count() == 40
    (rule,) = rules.values()
    assert sorted(map(len, rule.lists)) == [40, 40, 40] and rule.size == 3
    urls = ["http://n.test/?a7=1&b3=2&c0=3", "http://n.test/?a7=1&b3=2", "http://n.test/?a1&c2", "http://n.test/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame(list(url_filter.LISTED), "verdict string, host string, path string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, listed, mined).collect()} == {0: "block", 1: "allow", 2: "allow", 3: "allow"}


def plain_rules(rows, least, confidence):
    """Rules over query keys by trying every set of keys."""
    from itertools import combinations

    pages = [(frozenset(u.partition("?")[2].replace("=1", "").split("&")), bad) for u, bad in rows]
    n_bad = sum(b for _, b in pages)
    found = {}
    keys = sorted(set().union(*(k for k, _ in pages)))
    for size in range(1, len(keys) + 1):
        for s in combinations(keys, size):
            own = [b for k, b in pages if k >= set(s)]
            share = sum(own) / len(own) if own else 0
            if sum(own) >= least and share >= confidence and (1 - share) * url_filter.LEAST_GAIN <= 1 - n_bad / len(pages):
                found[s] = share
    return {s for s, c in found.items() if not any(found.get(s[:i] + s[i + 1 :], -1) >= c for i in range(len(s)))}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_equal_trying_all(spark, seed):
    import random

    rng, keys = random.Random(seed), "pqrstu"
    rows = []
    for i in range(400):
        own = [k for k in keys if rng.random() < 0.5] or ["p"]
        bad = {"p", "q"} <= set(own) and "u" not in own or {"r", "s", "t"} <= set(own) or rng.random() < 0.02
        rows.append((f"http://h{'abcdefghij'[i % 10]}x{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}.test/?" + "&".join(f"{k}=1" for k in own), bad))
    mined = url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    got = {tuple(t.removeprefix("q:") for t in r.tokens) for r in mined if all(t.startswith("q:") for t in r.tokens)}
    want = plain_rules(rows, url_filter.LEAST_PAGES, url_filter.CONFIDENCE)
    assert got == want and max(map(len, got)) >= 2


@needs_data
def test_disguised_words_are_restored(spark):
    """Over the commonest words of a corpus: digits and symbols for letters, a letter drawn out, letters set apart in several ways."""
    from collections import Counter

    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    restorer = toxicity.Restorer(toxicity.language_model(docs))
    counts = Counter(w for r in docs.select("text").collect() for w in re.findall("[a-z]{4,}", r.text.lower()))
    words = [w for w, _ in counts.most_common(500)]
    swap = lambda w, to: "".join(to.get(c, c) for c in w)
    middle = lambda w: w[: len(w) // 2] + w[len(w) // 2] * 6 + w[len(w) // 2 + 1 :]
    disguises = {
        "vowels": lambda w: swap(w, {"a": "4", "e": "3", "i": "1", "o": "0"}), "symbols": lambda w: swap(w, {"a": "@", "s": "$"}), "drawn": lambda w: w if re.search(r"(.)\1", w) else middle(w),
        "dots": ".".join, "blanks": " ".join, "wide": "  ".join, "tabs": "\t".join, "both": " \t ".join,
    }
    for name, disguise in disguises.items():
        hidden = [w for w in words if disguise(w) != w]
        found = sum(w in restorer.words(f"so {disguise(w)}, and") or w in restorer.words(f"so\n{disguise(w)}\nand") for w in hidden)
        assert found >= 0.95 * len(hidden), (name, found, len(hidden))
