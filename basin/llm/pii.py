"""PII surrogates: detected entities get keyed replacements of the same type, format and script.

DataFrame operations only. Texts with an entity are cut at the entities (``split`` and
``regexp_extract_all`` on one pattern); the distinct entities of the corpus form a table, in a canonical
form that ignores case in addresses and punctuation in numbers. A surrogate is drawn from SHA-256 of
key, type, canonical form and attempt. Entities whose surrogate equals another entity's surrogate, or
any entity found in the corpus, draw again until none does: distinct entities stay distinct, equal ones
stay equal wherever and however they are written. Names are replaced word by word, so "Mrs. Anna
Schmidt", "Anna Schmidt" and "Mrs. Schmidt" stay one person; local parts and domains of addresses are entities
of their own. Where a format has too few values (a one-letter domain, a secret of hyphens and one digit), every sixth
draw makes the surrogate a character (a name a syllable) longer. Numbers keep their length; should
``MAX_ROUNDS`` draws not tell them apart, that is an error that names them.

Types: e-mail (the top-level domain stays), telephone (first digit stays), card
number (any 16 digits, or 13 to 19 whose Luhn sum fits; first digit and Luhn validity stay), social security number,
IPv4 address, secret (``password=...``, ``token = "..."``: 8 characters with a digit, or 12 and more after an equals
sign; hexadecimal stays so, in its case), person names (titles, also stacked, or a
known given name, and all capitalised words, initials and particles such as "van der", which stay, that follow, the
last word the family name; gender by given
name, else title; initials go to other initials by a keyed cycle; Latin, Cyrillic or Greek letters stay so; upper case stays).

Only texts with an entity are shuffled, once; copies of a text are resolved once. Texts hold their
entities in one row, as they hold their words.

Edge cases: null, empty and entity-free texts come back as they are; ids are not used, so null and
repeated ids and rows are kept; all columns of the input are kept, with the text replaced and
``n_entities`` added (an input column of that name is replaced).
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basin.llm._common import drop_stored, stored

# Titles and given names with their gender.
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Madame", "Mme", "Госпожа", "Κυρία"]
TITLES_M = ["Mr", "Mister", "Herr", "Sr", "Señor", "Monsieur", "Господин", "Κύριος"]
TITLES_N = ["Dr", "Prof"]
GIVEN_F = ["Anna", "Maria", "Emma", "Sophie", "Laura", "Julia", "Sarah", "Mary", "Elizabeth", "Jennifer", "Claire",
           "Camille", "Carmen", "Lucía", "Ingrid", "Katharina", "Анна", "Мария", "Ольга", "Елена", "Μαρία", "Ελένη"]
GIVEN_M = ["John", "James", "Michael", "David", "Robert", "Peter", "Thomas", "Paul", "Pierre", "Jean", "Carlos", "José",
           "Hans", "Klaus", "Stefan", "Miguel", "Иван", "Сергей", "Дмитрий", "Алексей", "Γιώργος", "Νίκος"]
#: Draws after which entities that still share a surrogate are an error.
MAX_ROUNDS = 60
# Particles of family names.
PARTICLES = ["van", "von", "de", "der", "den", "del", "della", "di", "da", "dos", "ten", "ter", "zu", "bin", "ibn"]
# Alphabets, and the syllables that surrogate names are built of.
INITIALS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ÀÁÂÄÅÆÇĆČĐÈÉÊËÌÍÎÏŁÑÒÓÔÖØŚŠÙÚÛÜÝŻŽ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ",
            "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
LATIN, UPPER, HEX, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789"
SYLLABLES = {
    "latin": "ba be bo da de do fa fi ga go ha he jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa "
             "se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бо ва ве да де до жа за зо ка ки ко ла ле ли ло ма ми мо на не ни но па по ра ро са се со та те".split(),
    "greek": "βα γα γο δα δη θα θε κα κο λα λε λι μα με μι να νε νι πα πε ρα ρο σα σο τα τε φι φο".split(),
}
ENDINGS = {
    "latin": {"f": ["na", "lia", "ra", "tta"], "m": ["rd", "lf", "n", "rt"], "n": ["s", "l", "r", "ck"]},
    "cyrillic": {"f": ["на", "ла", "ра"], "m": ["н", "р", "й"], "n": ["в", "н", "к"]},
    "greek": {"f": ["να", "λη", "ρα"], "m": ["νος", "ρης", "ς"], "n": ["ς", "δης", "κης"]},
}

_TITLE = rf"(?:{'|'.join(TITLES_F + TITLES_M + TITLES_N)})"
_WORD = rf"(?!{_TITLE}(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}'’-]+"
_INITIALS = r"(?:\p{Lu}\.)+|\p{Lu}(?= )"
_REST = rf"(?: (?:{_INITIALS}|{_WORD}|(?:{'|'.join(PARTICLES)})(?= )))* {_WORD}"
NAME = (rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}(?:\.? {_TITLE})*\.?|(?:{'|'.join(GIVEN_F + GIVEN_M)})){_REST}(?![\p{{L}}\p{{N}}])")
_KEYWORD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[ \t]{0,3}"
_ASSIGN = _KEYWORD + r"[=:][ \t]{0,3}[\"']?"
_VALUE = r"[A-Za-z0-9+/_.-]*[A-Za-z0-9+/_-]"
SECRET = (rf"(?<![A-Za-z])(?:{_ASSIGN}(?=[A-Za-z0-9+/_.-]*\d){_VALUE}{{8}}"
          rf"|{_KEYWORD}=[ \t]{{0,3}}[\"']?{_VALUE}{{12}})")
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
PHONE = (r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
         r"|(?<!\w)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")
NUMERIC = "|".join([SECRET, EMAIL, IP, SSN, CARD, PHONE])
ANY = f"{NUMERIC}|{NAME}"


def has_entity(text: str) -> Column:
    """True if the text holds an entity. Most texts have no digit, @ or equals sign and skip those patterns."""
    t = F.col(f"`{text}`")
    return F.coalesce((t.rlike("[0-9@=]") & t.rlike(NUMERIC)) | t.rlike(NAME), F.lit(False))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit not doubled."""
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2 / 10).cast("int") + d.cast("int") * 2 % 10)),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _parts(m: Column) -> Column:
    """The parts of a found entity, joined by nothing: (kind, canon, raw); kind null: kept as it is."""
    part = lambda kind, canon, raw: F.struct(kind.alias("kind"), canon.alias("canon"), raw.alias("raw"))
    keep = lambda raw: part(F.lit(None).cast("string"), F.lit(None).cast("string"), raw)
    one = lambda kind, canon: F.array(part(F.lit(kind), canon, m))
    whole = lambda p: m.rlike(f"^(?:{p})$")
    lead = F.regexp_extract(m, f"^{_ASSIGN}", 0)
    value = F.substring(m, F.length(lead) + 1, F.length(m))
    secret_kind = F.when(value.rlike("^[0-9a-f]+$"), "secret_hex").when(
        value.rlike("^[0-9A-F]+$"), "secret_hex_upper").otherwise("secret")
    words = F.split(m, " ")
    title = lambda w, titles: F.regexp_replace(w, r"\.$", "").isin(titles)
    title_gender = F.when(F.exists(words, lambda w: title(w, TITLES_F)), "f").when(
        F.exists(words, lambda w: title(w, TITLES_M)), "m").otherwise("n")
    gender = lambda w: F.when(w.isin(GIVEN_F), "f").when(w.isin(GIVEN_M), "m").otherwise(title_gender)

    def name(w, i):
        family = (i > 0) & (i == F.size(words) - 1)
        kind = F.concat(F.when(family, F.lit("family_n")).otherwise(F.concat(F.lit("given_"), gender(w))),
                        F.lit("_"), _script(w))
        blank = F.when(i == 0, "").otherwise(" ")
        kind = F.when(w.rlike(r"^(?:\p{Lu}\.)+$|^\p{Lu}$"), F.lit("initial")).otherwise(kind)
        stays = title(w, TITLES_F + TITLES_M + TITLES_N) | w.isin(PARTICLES)
        return F.when(stays, F.array(keep(F.concat(blank, w)))).otherwise(
            F.array(keep(blank), part(kind, F.lower(w), w)))

    local, host = F.regexp_extract(m, "^[^@]*", 0), F.regexp_extract(m, r"@(.*)\.[^.]+$", 1)
    address = F.array(part(F.lit("local"), F.lower(local), local), keep(F.lit("@")), part(F.lit("domain"), F.lower(host), host),
                      keep(F.regexp_extract(m, r"\.[^.]+$", 0)))
    card_ok = (F.length(_digits(m)) == 16) | (_luhn_sum(_digits(m)) % 10 == 0)
    return (F.when(whole(SECRET), F.array(keep(lead), part(secret_kind, value, value)))
            .when(whole(EMAIL), address)
            .when(whole(IP), one("ip", m))
            .when(whole(SSN), one("ssn", _digits(m)))
            .when(whole(CARD), F.when(card_ok, one("card", _digits(m))).otherwise(F.array(keep(m))))
            .when(whole(PHONE), one("phone", _digits(m)))
            .otherwise(F.flatten(F.transform(words, name))))


def _stream(key: str, label: Column, size: Column) -> Column:
    """Pseudo-random hexadecimal digits, four for each of ``size`` characters."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 16).cast("int")), lambda k: F.sha2(
        F.concat_ws("|", F.lit(key), label, k.cast("string")), 256)), "")


def _number(stream: Column, i: Column, below) -> Column:
    return F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % below


def _redraw(value: Column, stream: Column, keep_first: bool = False, hexadecimal: str = "") -> Column:
    """Each digit becomes a digit, each Latin letter a letter of its case; the rest stays."""
    def char(c, i):
        pick = lambda letters: F.substring(F.lit(letters), _number(stream, i, len(letters)) + 1, F.lit(1))
        out = pick(hexadecimal) if hexadecimal else (
            F.when(c.rlike("[0-9]"), pick(DIGITS)).when(c.rlike("[a-z]"), pick(LATIN))
            .when(c.rlike("[A-Z]"), pick(UPPER)).otherwise(c))
        return F.when(i == 0, c).otherwise(out) if keep_first else out
    return F.array_join(F.transform(F.split(value, ""), char), "")


def _draw(key: str) -> Column:
    """Surrogate of (kind, canon, attempt) in canonical form."""
    kind, canon = F.col("kind"), F.col("canon")
    label = F.concat_ws("|", kind, canon, F.col("attempt").cast("string"))
    more = (F.col("attempt") / 6).cast("int")
    stream = _stream(key, label, F.length(canon) + more + 8)

    def longer(letters):
        drawn = F.transform(F.sequence(F.lit(1), more), lambda i: F.substring(
            F.lit(letters), _number(stream, F.length(canon) + i, len(letters)) + 1, F.lit(1)))
        return F.when(more > 0, F.array_join(drawn, "")).otherwise("")

    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (
        _number(stream, i, 254) + 1).cast("string")), ".")
    drawn = _redraw(canon, stream, keep_first=True)
    body = F.substring(drawn, F.lit(1), F.length(canon) - 1)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(_luhn_sum(canon) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(drawn)
    out = (F.when(kind.isin("local", "domain", "secret"), F.concat(_redraw(canon, stream), longer(LATIN)))
           .when(kind == "ip", ip).when(kind == "card", card)
           .when(kind == "phone", drawn).when(kind == "ssn", _redraw(canon, stream))
           .when(kind == "secret_hex", F.concat(_redraw(canon, stream, hexadecimal=HEX), longer(HEX)))
           .when(kind == "secret_hex_upper", F.concat(_redraw(canon, stream, hexadecimal=HEX.upper()), longer(HEX.upper()))))
    count = 2 + more  # longer names when short ones run out
    for script, syllables in SYLLABLES.items():
        parts = F.array(*map(F.lit, syllables))
        pick = lambda i: F.element_at(parts, _number(stream, i, len(syllables)) + 1)  # noqa: B023, E731
        head = F.array_join(F.transform(F.sequence(F.lit(1), count), pick), "")
        for gender, endings in ENDINGS[script].items():
            end = F.element_at(F.array(*map(F.lit, endings)), _number(stream, F.lit(0), len(endings)) + 1)
            out = out.when(kind.endswith(f"_{gender}_{script}"), F.concat(head, end))
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of the distinct (kind, canon) rows: one to one within a kind, and no
    surrogate is itself an entity of its kind."""
    now = stored(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))
                 .withColumn("surrogate", _draw(key)), "pii-entities")
    taken = entities.select("kind", F.col("canon").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    for _ in range(MAX_ROUNDS):
        first = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        judged = now.join(first, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left").withColumn(
            "clash", F.col("taken").isNotNull() | (F.struct("attempt", "canon") != F.col("first")))
        again = judged.select("kind", "canon", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"),
                              "clash", F.col("surrogate").alias("old"))
        step = stored(again.withColumn("surrogate", F.when(F.col("clash"), _draw(key)).otherwise(F.col("old")))
                      .drop("old"), "pii-entities")
        drop_stored(now)
        if step.filter("clash").isEmpty():
            return step.select("kind", "canon", "surrogate")
        now = step.drop("clash")
        now.stored_path = step.stored_path
    left = [f"{r.kind} {r.canon}" for r in step.filter("clash").select("kind", "canon").sort("kind", "canon").limit(10).collect()]
    raise RuntimeError(f"no distinct surrogates after {MAX_ROUNDS} draws, among others for: {', '.join(left)}")


def _initials(raw: Column, key: str) -> Column:
    """Each initial becomes another of its alphabet, by a keyed cycle: one to one, and never itself."""
    old, new = "", ""
    for letters in INITIALS:
        cycle = list(letters)
        random.Random(f"{key}|initials|{letters}").shuffle(cycle)
        old, new = old + "".join(cycle), new + "".join(cycle[1:] + cycle[:1])
    return F.translate(raw, old, new)


def _written(raw: Column, kind: Column, surrogate: Column, key: str) -> Column:
    """The surrogate as its entity was written: punctuation of numbers, case of addresses and names."""
    chars = F.split(raw, "")
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(
        surrogate, F.length(_digits(F.substring(raw, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    address = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(
        F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), "")
    address = F.concat(address, F.substring(surrogate, F.length(raw) + 1, F.length(surrogate)))
    named = F.when((raw == F.upper(raw)) & (F.length(raw) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (F.when(kind.isNull(), raw).when(kind == "initial", _initials(raw, key)).when(kind.isin("phone", "card", "ssn"), numbers)
            .when(kind.isin("local", "domain"), address).when(kind.rlike("^(given|family)_"), named).otherwise(surrogate))


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with every entity replaced, and ``n_entities``, the number replaced in each."""
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select([F.col(f"`{c}`") for c in columns])
    whole_text = F.col(f"`{text}`")
    cut = stored(docs.filter(has_entity(text)).select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.sha2(whole_text, 256).alias("copy"),
        F.split(whole_text, ANY, -1).alias("between"), F.regexp_extract_all(whole_text, F.lit(ANY), F.lit(0)).alias("found")),
        "pii-texts")
    parts = (cut.groupBy("copy").agg(F.first("found").alias("found"))
             .select("copy", F.posexplode("found").alias("at", "entity"))
             .select("copy", "at", F.posexplode(_parts(F.col("entity"))).alias("part", "p"))
             .select("copy", "at", "part", "p.kind", "p.canon", "p.raw"))
    parts = stored(parts, "pii-parts")
    table = surrogates(parts.filter("kind <> 'initial'"), key)
    written = parts.join(table, ["kind", "canon"], "left").select(
        "copy", "at", F.struct("part", _written(F.col("raw"), F.col("kind"), F.col("surrogate"), key).alias("s"),
                               F.col("kind").isNotNull().alias("replaced")).alias("part"))
    entities = written.groupBy("copy", "at").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    texts = entities.select("copy", F.struct(
        "at", F.array_join(F.col("parts.s"), "").alias("s"),
        F.exists("parts", lambda p: p["replaced"]).alias("replaced")).alias("entity")).groupBy("copy").agg(
        F.sort_array(F.collect_list("entity")).alias("entities"))
    whole = F.concat(F.array_join(F.flatten(F.transform("entities", lambda e, i: F.array(
        F.element_at(F.col("between"), i + 1), e["s"]))), ""), F.element_at("between", -1))
    count = F.size(F.filter("entities", lambda e: e["replaced"])).cast("bigint")
    changed = cut.join(texts, "copy").select(
        *[F.col(f"doc.`{c}`") if c != text else whole.alias(text) for c in columns], count.alias("n_entities"))
    untouched = docs.filter(~has_entity(text)).withColumn("n_entities", F.lit(0).cast("bigint"))
    return untouched.unionByName(changed)
