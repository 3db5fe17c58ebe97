"""Personal data replaced by keyed surrogates of the same kind.

Entities are e-mail addresses, phone numbers, payment card numbers, IPv4
addresses, social-security numbers and names: up to four words (initials,
hyphens, particles) after a form of address, and every other mention in the
same text of a word found so.
A surrogate depends on a secret key and the entity alone, so an entity
has the same surrogate everywhere.  Addresses and numbers are enciphered
within their own shape (letters stay letters of the same case and script,
digits digits, separators stay; card numbers stay valid, octets stay
octets): a bijection, so different entities stay different.  Phones are
keyed by their digits, so one number has one surrogate in all its formats
(with and without a country code they count as two).  Names come from
lists by script and gender, lengthened by syllables; they can collide.
The gender of a given name is that of most forms of address it follows in
the whole corpus (ties, "Dr" and no form of address: neutral), so "Dr
Anna", "Mrs Anna" and "Anna" agree and match.  Initials are shifted
letters and may coincide with others.

All distinct entities of the corpus are therefore checked: an entity whose
surrogate equals itself or another entity's surrogate is tried again with
the next attempt, which makes names longer, until none is left.  Only
entities with a gender or a later attempt need a table; it is broadcast
under a row bound and joined to the texts that hold such entities beyond it.

A given name that stands alone, without form of address or surname, is not
replaced where the same text uses the word in lower case, nor at the start
of a sentence if it is one of ``PLAIN_WORDS``.

Defined cases: null texts stay null, texts without entities stay as they
are; repeated rows and copies get equal replacements; overlapping matches
go to the leftmost, then to the kind listed first; an empty table gives
an empty result; all other columns pass through unchanged.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import materialise

KEY = b"replace this key outside tests"
MAX_BROADCAST = 100_000  # entities with a gender or a later attempt
# Names grow with every attempt and always end; numbers of one shape end
# unless (nearly) all numbers of that shape are entities.
FULL_SHAPE = 200
HOLDER = "__surrogates"

# A capital, a word of a name (O'Neil), words joined by hyphens, an initial.
_CAP = r"[^\W\d_a-zß-öø-ÿ]"
_PLAIN = rf"(?:{_CAP}['’])?{_CAP}[^\W\d_]+"
_JOINED = rf"{_PLAIN}(?:[-‐‑]{_PLAIN})*"
_INITIAL = rf"{_CAP}(?:\. ?| )"
_TITLES = r"(?:(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora|Señor|Sra|Sr)\.? )+"
_PARTICLE = r"(?:van|von|der|den|de|del|della|la|le|di|da|dos|du|al|bin|ibn|zu|ter|ten) "
_WORDS = rf"(?:{_INITIAL})*(?:{_PARTICLE})*{_JOINED}"

KINDS = (
    ("email", r"[\w.%+-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"),
    ("phone", r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
              r"|(?:\+\d|00[1-9]\d{0,2}[ ./-]\d)(?:[ ./()-]{0,2}\d){7,14}(?!\w)"
              r"|(?<![$€£.,/-])1?[2-9]\d{9}(?!\w|[.,]\d))"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    ("card", r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("name", rf"(?<!\w){_TITLES}{_WORDS}(?: {_WORDS}){{0,3}}"),
)
_NUMBERS = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS[1:5]))
_EMAIL, _NAME = re.compile(KINDS[0][1]), re.compile(KINDS[5][1])
_TITLE, _MENTION = re.compile(_TITLES), re.compile(rf"(?<!\w)(?:{_CAP}\. ?)*{_PLAIN}(?!\w)")
_PIECE = re.compile(rf"(?P<word>{_PLAIN})|(?P<initial>{_CAP})(?!\w)")
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65")

# Alphabets within which a character is replaced; others stay.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àâäáãåçèéêëìîïíñòôöóõùûüúÿ", "ÀÂÄÁÃÅÇÈÉÊËÌÎÏÍÑÒÔÖÓÕÙÛÜÚŸ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
_ALPHABET_OF = {ch: (a, i) for a in ALPHABETS for i, ch in enumerate(a)}

MALE = {"Mr", "Herr", "Monsieur", "Señor", "Sr"}
FEMALE = {"Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra"}
# Given names that start sentences as plain words.
PLAIN_WORDS = frozenset("""april art august bill chase christian dawn dean drew faith frank gene grace grant harmony
hope jack jean joy june mark may miles pat pearl ray rich rob rose ruby sue summer will""".split())

GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul Ralf Simon Tom Viktor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Elena Flora Greta Helena Ida Julia Karin Lena Maria Nora Olga Paula Rosa Sofia Tina Vera".split(),
    ("latin", "n"): "Alex Charlie Chris Dominique Eden Jamie Jean Jody Kim Lou Luca Maxime Morgan Nicola Noa Robin Sam Sascha Toni Yael".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Ирина Лидия Мария Нина".split(),
    ("cyrillic", "n"): "Саша Женя Валя".split(),
    ("greek", "m"): "Ανδρέας Γιώργος Δημήτρης Νίκος Πέτρος".split(),
    ("greek", "f"): "Άννα Ελένη Ιωάννα Μαρία Σοφία".split(),
    ("greek", "n"): "Φώτης Χάρις".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga go ha ka ke ko la le li lo ma me mi mo na ne ni no pa po ra re ri ro sa se so ta te ti to va".split(),
    "cyrillic": "ба бе во да де го ка ко ла ле ма ми на не но па ра ро са та то".split(),
    "greek": "βα γα δε κα κο λα λε μα με να νο πα ρα ρο σα τα το".split(),
}
ENDING = {"latin": "ner", "cyrillic": "ов", "greek": "ίδης"}  # of surnames


class Entity(NamedTuple):
    """``parts`` are (type, value, start, end) pieces replaced on their own;
    ``gender`` is what the form of address tells (m, f or n)."""
    kind: str
    start: int
    end: int
    parts: tuple
    gender: str = "n"


def luhn_ok(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def script_of(word: str) -> str:
    ch = word[0]
    return "cyrillic" if "Ѐ" <= ch <= "ӿ" else "greek" if "Ͱ" <= ch <= "Ͽ" else "latin"


def _folded(word: str) -> str:
    """What a word of a name is keyed by."""
    return word.lower().replace("’", "'")


def _part(kind: str, word: str, at: int) -> tuple:
    value = _folded(word)
    more = {"given": f":{script_of(value)}:n", "surname": f":{script_of(value)}", "initial": ""}[kind]
    return kind + more, value, at, at + len(word)


def _gender(title: str) -> str:
    words = set(re.split(r"[ .]+", title))
    return "n" if bool(words & MALE) == bool(words & FEMALE) else "m" if words & MALE else "f"


def _names(m: re.Match) -> Entity:
    """A form of address with a name; the last word and those it is joined
    to by hyphens are the surname."""
    text, at = m.string, _TITLE.match(m.string, m.start(), m.end()).end()
    pieces = list(_PIECE.finditer(text, at, m.end()))
    last = len(pieces) - 1
    while last and text[pieces[last].start() - 1] in "-‐‑":
        last -= 1
    return Entity("name", m.start(), m.end(), tuple(
        _part("initial" if p["initial"] else "surname" if i >= last else "given", p.group(), p.start())
        for i, p in enumerate(pieces)), _gender(text[m.start():at]))


def _plain(text: str, m: re.Match, words: set) -> bool:
    """Whether a word that stands alone may be no name."""
    w = _folded(m.group())
    return w in words or w in PLAIN_WORDS and not text[:m.start()].rstrip(" \n\t\"'(“«¿¡").rpartition("\n")[2][-1:].strip(".!?:")


def _mentions(text: str, named: list[Entity]) -> list[Entity]:
    """Mentions without a form of address of the words of ``named``; words
    side by side are one mention, the last a surname if it can be one."""
    words = set(re.findall(r"[^\W\d_]+", text))
    known = {k: {p[1] for e in named for p in e.parts if p[0].startswith(k)} for k in ("given", "surname")}
    runs = []
    for m in _MENTION.finditer(text):
        pieces = list(_PIECE.finditer(text, m.start(), m.end()))
        if any(_folded(pieces[-1].group()) in x for x in known.values()):
            if runs and m.start() == runs[-1][-1].end() + 1 and text[m.start() - 1] in " -‐‑":
                runs[-1] += pieces
            else:
                runs.append(pieces)
    out = []
    for pieces in runs:
        if len(pieces) == 1 and _folded(pieces[0].group()) not in known["surname"] and _plain(text, pieces[0], words):
            continue
        parts = []
        for i, p in enumerate(pieces):
            first, second = ("surname", "given") if i == len(pieces) - 1 else ("given", "surname")
            kind = "initial" if p["initial"] else first if _folded(p.group()) in known[first] else second
            parts.append(_part(kind, p.group(), p.start()))
        out.append(Entity("name", pieces[0].start(), pieces[-1].end(), tuple(parts)))
    return out


def find_entities(text: str | None) -> list[Entity]:
    """Entities of a text in order, not overlapping."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [Entity("email", m.start(), m.end(), (("email", m.group(), m.start(), m.end()),))
                  for m in _EMAIL.finditer(text)]
    for m in _NUMBERS.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
            continue
        if kind == "card":
            digits = re.sub("[ -]", "", value)
            if not (_ISSUERS.match(digits) and luhn_ok(digits)):
                continue
        value = _dialled(value) if kind == "phone" else value
        found.append(Entity(kind, m.start(), m.end(), ((kind, value, m.start(), m.end()),)))
    named = [_names(m) for m in _NAME.finditer(text)]
    found += named + (_mentions(text, named) if named else [])
    found.sort(key=lambda e: (e.start, [k for k, _ in KINDS].index(e.kind)))
    out, end = [], 0
    for e in found:
        if e.start >= end:
            out.append(e)
            end = e.end
    return out


def _pad(key: bytes, *parts) -> int:
    data = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(data, key=key, digest_size=64).digest(), "big")


def encipher(key: bytes, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
    """Keyed bijection of digit strings of mixed radix: each half in turn
    is shifted by a pad made from the other."""
    half, out = len(values) // 2, list(values)
    for r in range(8):
        here, there = (range(half, len(out)), out[:half]) if r % 2 else (range(half), out[half:])
        pad, used = _pad(key, tweak, r, sizes, there), 0
        for i in here:
            if used > 440:  # bits of one pad, less a margin that keeps its remainders even
                pad, used = _pad(key, tweak, r, i, sizes, there), 0
            out[i] = (out[i] + pad % sizes[i]) % sizes[i]
            pad //= sizes[i]
            used += sizes[i].bit_length()
    return out


def _shaped(key: bytes, tweak: str, value: str, fixed: int = 0) -> str:
    spots = [i for i, ch in enumerate(value) if i >= fixed and ch in _ALPHABET_OF]
    places = [_ALPHABET_OF[value[i]] for i in spots]
    new = encipher(key, tweak, [p[1] for p in places], [len(p[0]) for p in places])
    out = list(value)
    for i, p, n in zip(spots, places, new):
        out[i] = p[0][n]
    return "".join(out)


def _card(key: bytes, tweak: str, value: str) -> str:
    """The issuer's digits stay, the check digit is computed anew."""
    issuer = _ISSUERS.match(re.sub("[ -]", "", value))
    body = _shaped(key, tweak, value[:-1], issuer.end() if issuer else 1)
    return next(body + d for d in "0123456789" if luhn_ok(re.sub("[ -]", "", body + d)))


def _dialled(phone: str) -> str:
    """The digits of a phone number, with + before a country code."""
    digits = re.sub(r"\D", "", phone.replace("(0)", ""))
    return "+" + digits if phone.startswith("+") else "+" + digits[2:] if phone.startswith("00") else digits


def _poured(number: str, shape: str) -> str:
    """The digits of ``number`` in the places of the last digits of ``shape``."""
    digits, out = [c for c in number if c.isdigit()], list(shape)
    trunk = shape.find("(0)") + 1
    for i in reversed(range(len(out))):
        if digits and out[i].isdigit() and not (trunk and i == trunk):
            out[i] = digits.pop()
    return "".join(out)


def _phone(key: bytes, tweak: str, number: str) -> str:
    """The country code, or all but the last nine digits, stay."""
    return _shaped(key, tweak, number, 4 if number.startswith("+") else max(0, len(number) - 9))


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0, gender: str | None = None) -> str:
    """Replacement of one entity part; ``gender`` of a given name, if known."""
    kind, *more = kind.split(":")
    tweak = f"{kind}/{attempt}"
    if kind == "email":
        end = value.rindex(".")
        return _shaped(key, tweak, value[:end]) + value[end:]
    if kind == "phone":
        return _poured(_phone(key, tweak, _dialled(value)), value)
    if kind == "card":
        return _card(key, tweak, value)
    if kind == "ip":
        return ".".join(map(str, encipher(key, tweak, [int(x) for x in value.split(".")], [256] * 4)))
    if kind == "ssn":
        return _shaped(key, tweak, value)
    if kind == "initial":
        letters, i = _ALPHABET_OF.get(value, ("yx", 0))
        return letters[(i + 1 + _pad(key, kind, letters) % (len(letters) - 1)) % len(letters)]
    script = more[0]
    gender = (gender or more[1]) if kind == "given" else "s"
    pad = _pad(key, tweak, script, gender, value.lower())
    pool = GIVEN.get((script, gender), [""])
    name, pad = pool[pad % len(pool)], pad // len(pool)
    for _ in range((1 if kind == "given" else 2) + attempt):
        name += SYLLABLES[script][pad % len(SYLLABLES[script])]
        pad //= len(SYLLABLES[script])
    name = (name if kind == "given" else name + ENDING[script]).capitalize()
    return name.upper() if value.isupper() else name


def replace_entities(text: str, attempts, key: bytes = KEY) -> tuple[str, list[str]]:
    """(new text, kind:start:end of the entities in the old text)."""
    out, at, spans = [], 0, []
    for e in find_entities(text):
        for kind, value, start, end in e.parts:
            new = surrogate(key, kind, value, *attempts.get((kind, value), (0, None)))
            if kind == "phone":
                new = _poured(new, text[start:end])
            upper = e.kind == "name" and text[start:end].isupper()
            out += [text[at:start], new.upper() if upper else new]
            at = end
        spans.append(f"{e.kind}:{e.start}:{e.end}")
    return ("".join(out) + text[at:], spans) if spans else (text, spans)


def slices(batches, rows: int = 256):
    """Arrow batches in short pieces, so that few texts are Python strings
    at a time."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def entity_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, value, gender) of all texts but initials, which have
    one attempt; tasks fold their batches first.  The gender is m or f where
    more forms of address of all rows say so than the opposite, else null."""
    def task(batches):
        for batch in slices(batches):
            votes = {}
            for t in batch.column(0).to_pylist():
                for e in find_entities(t):
                    for p in e.parts:
                        if p[0] != "initial":
                            votes[p[:2]] = votes.get(p[:2], 0) + (p[0].startswith("given") and {"m": 1, "f": -1}.get(e.gender, 0))
            yield pa.record_batch({"kind": pa.array([k for k, _ in votes], pa.string()),
                                   "value": pa.array([v for _, v in votes], pa.string()),
                                   "votes": pa.array(list(votes.values()), pa.int64())})
    n = F.sum("votes")
    return docs.select(text).mapInArrow(task, "kind string, value string, votes bigint").groupBy("kind", "value").agg(
        F.when(n > 0, "m").when(n < 0, "f").alias("gender"))


def later_attempts(parts: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, value, attempt, gender) of the entities that have a gender or
    whose first surrogate equals the entity or another one's surrogate.  Of
    those that share a surrogate the lowest attempt, then the first value
    keeps it, so what is settled stays; only the others are tried again.

    ``parts`` are distinct (kind, value), with a ``gender`` or without."""
    schema = "kind string, value string, gender string, attempt int, surrogate string"

    def task(batches):
        for batch in batches:
            kind, value, gender, attempt = (batch.column(i).to_pylist() for i in range(4))
            new = [surrogate(key, *x) for x in zip(kind, value, attempt, gender)]
            yield pa.record_batch({**{c: batch.column(c) for c in ("kind", "value", "gender", "attempt")},
                                   "surrogate": pa.array(new, pa.string())})

    gender = F.col("gender") if "gender" in parts.columns else F.lit(None).cast("string")
    now = parts.select("kind", "value", gender.alias("gender"), F.lit(0).cast("int").alias("attempt"))
    tried = materialise(now.mapInArrow(task, schema))
    same = (F.col("attempt") == F.col("keeper.attempt")) & (F.col("value") == F.col("keeper.value"))
    good = same & (F.lower("surrogate") != F.lower("value"))
    for _ in range(FULL_SHAPE):
        keepers = tried.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "value")).alias("keeper"))
        judged = materialise(tried.join(keepers, ["kind", "surrogate"])
                             .select("kind", "value", "gender", "attempt", "surrogate", good.alias("good")))
        if judged.where("NOT good").isEmpty():
            return judged.where("attempt > 0 OR gender IS NOT NULL").select("kind", "value", "attempt", "gender")
        again = judged.where("NOT good").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt"))
        tried = materialise(judged.where("good").drop("good").unionByName(again.mapInArrow(task, schema)))
    raise RuntimeError(f"entities still collide after {FULL_SHAPE} attempts: all values of a shape are taken")


def replace_personal_data(docs: DataFrame, text: str = "text", key: bytes = KEY,
                          max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """All input columns, ``text`` replaced, and HOLDER: a struct of
    ``n_entities`` and ``entities`` (kind:start:end in the old text)."""
    parts = materialise(entity_parts(docs, text))
    later = materialise(later_attempts(parts, key))
    n = later.count()
    named, shared = "__attempts", None
    if n <= max_broadcast:
        shared = docs.sparkSession.sparkContext.broadcast({(r[0], r[1]): (r[2], r[3]) for r in later.collect()})
        rows = docs.withColumn(named, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int,gender:string>>"))
    else:
        rows = _with_attempts(docs, later, text, named)
    order = [c for c in rows.columns if c not in (text, named)]

    def task(batches):
        common = shared.value if shared is not None else {}
        for batch in slices(batches):
            texts, own = batch.column(text).to_pylist(), batch.column(named).to_pylist()
            new, spans = [], []
            for t, a in zip(texts, own):
                known = {(x["kind"], x["value"]): (x["attempt"], x["gender"]) for x in a} if a else common
                got = (t, []) if t is None else replace_entities(t, known, key)
                new.append(got[0])
                spans.append(got[1])
            kept = {c: batch.column(c) for c in order}
            yield pa.record_batch({**kept, text: pa.array(new, pa.string()),
                                   "__n": pa.array([len(x) for x in spans], pa.int32()),
                                   "__spans": pa.array([",".join(x) for x in spans], pa.string())})

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in order) + f", `{text}` string, __n int, __spans string"
    out = rows.select(*order, text, named).mapInArrow(task, schema)
    return out.withColumn(HOLDER, F.struct(F.col("__n").alias("n_entities"), F.col("__spans").alias("entities"))) \
        .select(*docs.columns, HOLDER)


def _with_attempts(docs: DataFrame, later: DataFrame, text: str, name: str) -> DataFrame:
    """Every row with the attempts and genders of its own entities (or null)."""
    def task(batches):
        for batch in slices(batches):
            uid, kind, value = [], [], []
            for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, v in {p[:2] for e in find_entities(t) for p in e.parts}:
                    uid.append(u)
                    kind.append(k)
                    value.append(v)
            yield pa.record_batch({"__uid": pa.array(uid, pa.string()), "kind": pa.array(kind, pa.string()),
                                   "value": pa.array(value, pa.string())})

    uid = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    held = docs.select(uid.alias("__uid"), text).mapInArrow(task, "__uid string, kind string, value string").distinct()
    per_text = held.join(later, ["kind", "value"]).groupBy("__uid").agg(
        F.collect_list(F.struct("kind", "value", "attempt", "gender")).alias(name))
    return docs.withColumn("__uid", uid).join(per_text, "__uid", "left").drop("__uid")


def without_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows with replaced texts and the input's own columns; a column
    ``n_chars`` follows the new text."""
    out = replace_personal_data(docs, text)
    if "n_chars" in docs.columns:
        changed = F.col(f"{HOLDER}.n_entities") > 0
        out = out.withColumn("n_chars", F.when(changed, F.char_length(text).cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
