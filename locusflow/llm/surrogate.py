"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

An entity's surrogate is a keyed permutation of its letters and digits within
their kinds, so equal entities get equal surrogates everywhere and different ones
different surrogates. Letters of scripts without groups of their own are exchanged
within their block of the character table. Of a titled name the given name and the surname are
entities of their own, so a surname has one surrogate with or without a given name; a given
name is replaced by one of its gender, which the lists or else the title tell. Check digits
stay right, private addresses private. Emails, phone, card, account and identity numbers, IP
addresses, secrets and names are found: names by a title or by a given name of the lists, and
what is a name in one place of a text is one in every other. A global check gives further tries
to surrogates that equal some real entity or one another, until none does; after
ROUNDS tries surrogates grow longer, so that free ones do not run out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import cut, documents, row_id, texts

#: The key of the registered query and of tests; whoever publishes surrogates passes a secret one.
KEY = b"surrogate-key-1"
#: Entities that need a further try are broadcast up to this number and joined to their documents beyond it.
BROADCAST_FIXES = 50_000
ROUNDS = 6
# Patterns of entities.
PATTERNS = {
    "secret": r"(?i:(?<![\w])(?:api[_-]?key|token|secret|password|passwd)\s*[=:]\s*[\"']?)(?P<secret>[\w\-+/]{8,})",
    "email": r"(?<![\w.+-])(?P<email>[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8})",
    "iban": r"(?<![\w])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w])",
    "phone": r"(?<![\w])(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4})(?![\w])",
    "ssn": r"(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])",
    "ip": r"(?<![\w.])(?P<ip>(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?![\w]|\.[0-9])",
    "card": r"(?<![\w])(?P<card>[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7})(?![\w])",
}
# Titles that tell a gender; 0 for women, 1 for men.
GENDER = dict.fromkeys("Mrs Ms Miss Frau Madame Mme Señora Sra".split(), 0) | dict.fromkeys("Mr Herr Monsieur Señor Sr".split(), 1)
# Private address ranges as (first address, bits that are free).
PRIVATE = ((10 << 24, 24), (127 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16))
# Particles that stand small between given name and surname.
PARTICLE = r"(?:van(?: der| den| de)?|von(?: der| dem)?|de(?: la| los)?|del|della|di|da|dos|du|bin|ibn|ten|ter) "
#: A name's word: letters with their marks, parts joined by hyphen or apostrophe; a final 's is not of the name.
_LETTERS = r"(?:[^\W\d_][\u0300-\u036f]*)+"
NAME_WORD = rf"{_LETTERS}(?:['’-](?!s(?![^\W\d_])){_LETTERS})*"
_TITLES = [*GENDER, "Dr"]
NAME = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted({*_TITLES, *map(str.upper, _TITLES)}, reverse=True))})\.? (?:{PARTICLE})*(?P<first>{NAME_WORD})(?: (?:{PARTICLE})*(?P<second>{NAME_WORD}))?")
WORDS = re.compile(rf"(?<![\w'’-]){NAME_WORD}")
# Given names by gender and script; a surrogate comes from the same list.
GIVEN = (
    "Anna Clara Emma Eva Ida Julia Laura Lena Lisa Maria Marie Nina Olivia Paula Rosa Sara Sofia Vera Alice Lucy".split(),
    "Adam Alan Anton Carl David Erik Felix Hugo Ivan Jan John Karl Leo Louis Lucas Marco Martin Oscar Paul Peter".split(),
    "Анна Вера Елена Ирина Мария Нина Ольга Софья Татьяна Юлия".split(),
    "Антон Борис Виктор Иван Олег Павел Пётр Сергей Фёдор Юрий".split(),
)
#: A given name of the lists before a word, without title; a number before it makes it a date.
UNTITLED = re.compile(rf"(?<![\w'’-])(?<!\d )(?P<first>{'|'.join(w for g in GIVEN for w in g)}) (?:{PARTICLE})*(?P<second>{NAME_WORD})")
_LISTED = tuple(f"{w} " for g in GIVEN for w in g)
_JOINS_NAME = re.compile(f" (?:{PARTICLE})*")
#: Letters that are exchanged within their group: vowels for vowels keeps names speakable, scripts stay apart.
GROUPS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
#: Blocks of one script that are longer than 128 places: Chinese characters and Hangul.
BLOCKS = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7B0))
HEX = "0123456789abcdef"
FIND = re.compile("|".join(PATTERNS.values()))
_QUICK = re.compile(r"[0-9@]|(?i:token|secret|password|passwd|api.?key)")


def _number(kind: str, tweak: str, round_: int, half: str, size: int, key: bytes) -> int:
    return int.from_bytes(blake2b(f"{kind}\0{tweak}\0{round_}\0{half}".encode(), key=key, digest_size=16).digest(), "big") % size


def permute_number(v: int, low: int, high: int, kind: str, tweak: str, key: bytes) -> int:
    """A keyed permutation of 0 .. low * high - 1: eight rounds of a Feistel sum of two parts."""
    x, y = v % low, v // low
    for i in range(8):
        if i % 2 and low > 1:
            x = (x + _number(kind, tweak, i, str(y), low, key)) % low
        elif not i % 2:
            y = (y + _number(kind, tweak, i, str(x), high, key)) % high
    return x + y * low


def permute(symbols: str, alphabet: str, kind: str, tweak: str, key: bytes = KEY) -> str:
    """A keyed permutation of strings of one length over an alphabet."""
    n, r = len(symbols), len(alphabet)
    if not n:
        return ""
    v = sum(alphabet.index(c) * r**i for i, c in enumerate(symbols))
    v = permute_number(v, r ** (n // 2), r ** (n - n // 2), kind, f"{tweak}{n}", key)
    return "".join(alphabet[v // r**i % r] for i in range(n))


@cache
def block_of(c: str) -> str:
    """The lower-case letters outside GROUPS that ``c`` is exchanged with; none if ``c`` is no such letter."""
    fits = lambda x: x.isalpha() and x == x.lower() and x.upper().lower() == x == x.title().lower() and not any(x in g for g in GROUPS)
    if not fits(c):
        return ""
    own = next(((a, b) for a, b in BLOCKS if a <= ord(c) < b), (ord(c) & ~0x7F, (ord(c) | 0x7F) + 1))
    return "".join(filter(fits, map(chr, range(*own))))


def longer(value: str, kind: str, tweak: str, alphabet: str, n: int, key: bytes) -> str:
    """``n`` keyed symbols of an alphabet, to make a surrogate longer."""
    return "".join(alphabet[_number(kind, f"{tweak}+{value}", i, "", len(alphabet), key)] for i in range(n))


def luhn(digits: str) -> bool:
    d = [int(c) for c in digits]
    return sum(d[-1::-2]) % 10 + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) % 10 in (0, 10)


def mod_97(iban: str) -> int:
    """The remainder that is 1 for right check digits: the first four places at the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def exchange(value: str, kind: str, tweak: str, groups=GROUPS, key: bytes = KEY) -> str:
    """Each group's symbols of a lower-cased value permuted among themselves; others stay in place."""
    out = list(value)
    for g in groups:
        at = [i for i, c in enumerate(value) if c in g]
        for i, c in zip(at, permute("".join(value[i] for i in at), g, kind, tweak, key), strict=True):
            out[i] = c
    rest: dict[str, list[int]] = {}
    for i, c in enumerate(value):
        if not any(c in g for g in groups) and block_of(c):
            rest.setdefault(block_of(c), []).append(i)
    for g, at in rest.items():
        for i, c in zip(at, permute("".join(value[i] for i in at), g, kind, tweak, key), strict=True):
            out[i] = c
    return "".join(out)


def normal(kind: str, value: str) -> str:
    """The form by which two mentions are one entity: letters lower-cased; cards, phones, IBANs without separators."""
    return re.sub(r"[ .()|-]", "", value).lower() if kind in ("card", "phone", "iban") else value.lower()


def gender_list(word: str):
    return next((g for g in GIVEN if word.capitalize() in g), None)


def address_of(value: str, attempt: int, key: bytes) -> str:
    """An address of the same range: private ones stay within theirs, others outside all of these.

    A private range may be full of real addresses, so later tries go over to 10.0.0.0 and then to all.
    """
    n = 0
    for part in value.split("."):
        n = n << 8 | int(part)
    inside = lambda v: next(((at, bits) for at, bits in PRIVATE if at <= v < at + (1 << bits)), None)
    own, tweak = inside(n), str(attempt)
    if own and attempt <= 2 * ROUNDS:
        at, bits = own if attempt <= ROUNDS else PRIVATE[0]
        v = at + permute_number((n ^ at) % (1 << bits), 1 << bits // 2, 1 << bits - bits // 2, "ip", tweak, key)
    else:
        v = permute_number(n, 1 << 16, 1 << 16, "ip", tweak, key)
        while inside(v):  # walks on along the permutation's cycle, so different addresses stay apart
            v = permute_number(v, 1 << 16, 1 << 16, "ip", tweak, key)
    return ".".join(str(b) for b in v.to_bytes(4, "big"))


def given_name(kind: str, value: str, attempt: int, key: bytes) -> str:
    """A given name of the gender that ``kind`` names.

    Listed names change places within their list. Others become several names of the
    list in one word, or joined by hyphens if they have one themselves; one name more with
    each try, so that free ones do not run out.
    """
    own = gender_list(value)
    if own and not attempt:
        keyed = sorted(own, key=lambda w: _number(kind, "0", 0, w, 1 << 62, key))
        return keyed[own.index(value.capitalize())].lower()
    cyrillic = 0x400 <= ord(value[0]) < 0x530
    names = GIVEN[int(kind[-1]) + 2 * cyrillic]
    return ("-" if "-" in value else "").join(names[_number(kind, f"{attempt} {value}", i, "", len(names), key)].lower() for i in range(2 + attempt))


def surrogate_of(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The surrogate of a normal form, in normal form; after ROUNDS attempts a longer one, except of IP addresses."""
    tweak = str(attempt)
    if kind == "ip":
        return address_of(value, attempt, key)
    if kind in ("given0", "given1"):
        return given_name(kind, value, attempt, key)
    if attempt > ROUNDS:
        more = attempt - ROUNDS + 1
        digits = kind in ("card", "phone", "iban", "ssn")
        alphabet = "0123456789" if digits else HEX if kind == "secret" else next((a for a in (block_of(value[-1]), *GROUPS[1:]) if value[-1] in a), GROUPS[1])
        if kind == "card":
            new = exchange(value, kind, tweak, key=key) + longer(value, kind, tweak, alphabet, more, key)
            return next(new + c for c in "0123456789" if luhn(new + c) == luhn(value))
        new, end = surrogate_of(kind, value, attempt - ROUNDS - 1, key), longer(value, kind, tweak, alphabet, more, key)
        if kind == "email":
            local, _, domain = new.partition("@")
            return local + longer(value, kind, tweak, GROUPS[2], more, key) + "@" + domain
        return checked_iban(new + end) if kind == "iban" and mod_97(value) == 1 else new + end
    if kind == "email":
        local, _, domain = value.partition("@")
        host, dot, tld = domain.rpartition(".")
        return exchange(local, kind, f"{tweak}l{domain}", key=key) + "@" + exchange(host, kind, "d" if not attempt else tweak, key=key) + dot + tld
    if kind == "phone":
        head = next((h for h in ("+1",) if value.startswith(h)), value[:3] if value.startswith("+") else "")
        return head + exchange(value[len(head) :], kind, tweak, key=key)
    if kind == "iban":
        if mod_97(value) == 1:
            return checked_iban(value[:4] + exchange(value[4:], kind, tweak, key=key))
        new = value[:2] + exchange(value[2:], kind, tweak, key=key)
        return new if mod_97(new) != 1 else surrogate_of(kind, new, attempt, key)
    if kind == "card":
        if not luhn(value):
            new = exchange(value, kind, tweak, key=key)
            return new if not luhn(new) else surrogate_of(kind, new, attempt, key)
        body = exchange(value[:-1], kind, tweak, key=key)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "secret" and all(c in HEX for c in value):
        return exchange(value, kind, tweak, (HEX,), key)
    return exchange(value, kind, tweak, key=key)


def checked_iban(iban: str) -> str:
    """The IBAN with the check digits that its other places ask for."""
    return f"{iban[:2]}{98 - mod_97(iban[:2] + '00' + iban[4:]):02d}{iban[4:]}"


def redress(kind: str, shown: str, new: str) -> str:
    """A surrogate in the dress of the mention: its separators and its letters' case."""
    out, chars = [], iter(new)
    if kind in ("card", "phone", "iban"):
        new = "".join(next(chars) if not re.match(r"[ .()|-]", c) else c for c in shown) + "".join(chars)
    if kind.startswith("given") or kind == "name" and len(new) != len(shown):
        return new.upper() if shown.isupper() and len(shown) > 1 else re.sub(_LETTERS, lambda m: m.group().capitalize(), new)
    if len(new) != len(shown):
        return new.upper() if shown.isupper() else new
    for c, s in zip(new, shown, strict=True):
        out.append(c.upper() if s.isupper() else c)
    return "".join(out)


def clear_of(found: list[tuple[int, int, str]]):
    """Tells whether a span overlaps none of the found ones, which are sorted and apart."""
    starts = [x for x, _, _ in found]

    def clear(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not i or found[i - 1][1] <= a

    return clear


def capital(word: str) -> bool:
    """Whether a word starts like a name; letters of scripts without case do."""
    return word[0] == word[0].title()


def given_kind(word: str, title: str) -> str:
    """``given0`` or ``given1`` for given names of women and men by the lists or the title, ``given`` for others."""
    own = gender_list(word)
    gender = GIVEN.index(own) % 2 if own else GENDER.get(title.capitalize(), "")
    return f"given{gender if own or word.isascii() or 0x400 <= ord(word[0]) < 0x530 else ''}"


def named_persons(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of names outside ``found``: titled ones, listed given names before a capital, and their words elsewhere in the text."""
    full = [(m, m.group("title")) for m in NAME.finditer(text)]
    out, single, clear = [], [], clear_of(found)
    for m, title in full:
        first, second = m.group("first"), m.group("second")
        shouted = title.isupper() and len(title) > 1
        fits = lambda w: w and capital(w) and (w.isupper() or not shouted)  # noqa: B023, E731
        if not fits(first) or not clear(m.start(), m.end("first")):
            continue
        if fits(second) and clear(m.start(), m.end("second")):
            out += [(*m.span("first"), given_kind(first, title)), (*m.span("second"), "name")]
        else:
            single.append(m.span("first"))
    if any(w in text for w in _LISTED):
        clear = clear_of(sorted([*found, *out, *((*x, "name") for x in single)]))
        for m in UNTITLED.finditer(text):
            if len(m.group("second")) > 1 and capital(m.group("second")) and clear(*m.span()):
                out += [(*m.span("first"), given_kind(m.group("first"), "")), (*m.span("second"), "name")]
    given: dict[str, str] = {}
    for a, b, kind in out:
        if kind != "name":
            given[text[a:b].lower()] = max(kind, given.get(text[a:b].lower(), ""), key=len)
    surnames = {text[a:b].lower() for a, b, kind in out if kind == "name"}
    out = [(a, b, given[text[a:b].lower()] if kind == "given" else kind) for a, b, kind in out]
    for a, b in single:
        word = text[a:b].lower()
        out.append((a, b, "name" if word in surnames else given.get(word, "name")))
    surnames |= {text[a:b].lower() for a, b, kind in out if kind == "name"}
    if out:
        clear = clear_of(sorted([*found, *out]))
        for m in WORDS.finditer(text):
            word = m.group().lower()
            if (word in surnames or word in given) and capital(m.group()) and clear(*m.span()):
                out.append((*m.span(), "name" if word in surnames else given[word]))
    return out


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all entities of a text, in order, without overlaps; a null or empty text has none.

    A name's parts are apart: ``given0`` and ``given1`` are given names of women and
    men, ``given`` those of no known gender, ``name`` is a surname or all that is said.
    A word that is part of a name anywhere in the text is one wherever it stands with a
    capital; one that is both is a surname.
    """
    if not text:
        return []
    found = [(*m.span(m.lastgroup), m.lastgroup) for m in FIND.finditer(text)] if _QUICK.search(text) else []
    return sorted(found + named_persons(text, found))


def replace(text: str | None, attempts: dict, key: bytes = KEY) -> tuple[str | None, int, int]:
    """The text with surrogates, and how many mentions and distinct entities it has.

    A given name counts with the surname that follows; alone it is a mention of
    the person whose full name the text has.
    """
    out, end, seen, mentioned = [], 0, set(), 0
    found = entities(text)
    for i, (a, b, kind) in enumerate(found):
        value = normal(kind, text[a:b])
        joined = i + 1 < len(found) and found[i + 1][2] == "name" and _JOINS_NAME.fullmatch(text, b, found[i + 1][0])
        if not kind.startswith("given"):
            seen.add((kind, value))
        mentioned += not (kind.startswith("given") and joined)
        out += [text[end:a], redress(kind, text[a:b], surrogate_of(kind, value, attempts.get((kind, value), 0), key))]
        end = b
    return (text if not found else "".join(out) + text[end:]), mentioned, len(seen)


def mentions(docs: DataFrame) -> DataFrame:
    """(id, kind, value): distinct entities per row of (id, text)."""

    def run(batches):
        for b in batches:
            got = [(i, *e) for i, t in zip(b.column("id").to_pylist(), texts(b), strict=True) for e in sorted({(k, normal(k, t[x:y])) for x, y, k in entities(t)})]
            cols = list(zip(*got, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["id", "kind", "value"])

    return docs.mapInArrow(run, "id long, kind string, value string")


def with_surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """``values`` (kind, value, attempt) with ``new``."""

    def run(batches):
        for b in batches:
            k, v, a = (b.column(c).to_pylist() for c in ("kind", "value", "attempt"))
            new = pa.array([surrogate_of(*x, key) for x in zip(k, v, a, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=[*b.schema.names, "new"])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, new string")


def further_tries(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the entities whose first surrogate is taken.

    ``values`` are the corpus's distinct entities. A surrogate is taken if it is
    an entity of the corpus or another entity's surrogate; of several that meet, the
    least entity keeps it. Given names of a list may be those of others, as there are few. Each round gives the losers their next try, until there are none.
    """
    real = values.where("kind not in ('given0', 'given1')").select("kind", F.col("value").alias("new"))
    now = cut(with_surrogates(values.withColumn("attempt", F.lit(0)), key))
    while True:
        keeper = now.groupBy("kind", "new").agg(F.min("value").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("kind", "new", "keeper")
        taken = now.join(real, ["kind", "new"], "left_semi").select("kind", "value", "attempt")
        lost = now.join(keeper, ["kind", "new"]).where("value <> keeper").select("kind", "value", "attempt")
        bad = cut(taken.unionByName(lost).distinct())
        if not bad.limit(1).count():
            break
        again = with_surrogates(bad.withColumn("attempt", F.col("attempt") + 1), key)
        now = cut(now.join(bad, ["kind", "value"], "left_anti").unionByName(again))
    return now.where("attempt > 0").select("kind", "value", "attempt")


def surrogate_documents(docs: DataFrame, broadcast_fixes: int = BROADCAST_FIXES, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_mentions, n_entities): texts with their entities replaced.

    Null and empty texts stay as they are, repeated rows are replaced alike, an
    empty table gives no rows, further columns are ignored.
    """
    rows = docs.select(row_id(F.col("doc_id"), F.col("text")).alias("id"), "doc_id", "text")
    found = cut(mentions(rows.select("id", "text")))
    fixes = cut(further_tries(found.select("kind", "value").distinct(), key))
    few = fixes.count() <= broadcast_fixes
    table = {(r.kind, r.value): r.attempt for r in fixes.collect()} if few else {}
    shared = docs.sparkSession.sparkContext.broadcast(table)  # at most broadcast_fixes entries
    rows = rows.withColumn("fixes", F.expr("cast(null as array<struct<kind:string,value:string,attempt:int>>)"))
    if not few:
        own = found.join(fixes, ["kind", "value"]).distinct().groupBy("id").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("fixes"))
        rows = rows.drop("fixes").join(own, "id", "left")

    def run(batches):
        for b in batches:
            out = [replace(t, {(x["kind"], x["value"]): x["attempt"] for x in f} if f else shared.value, key) for t, f in zip(texts(b), b.column("fixes").to_pylist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["doc_id", "text", "n_mentions", "n_entities"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_mentions long, n_entities long"
    return rows.select("doc_id", "text", "fixes").mapInArrow(run, schema)


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_documents(documents(spark, sf_dir))
