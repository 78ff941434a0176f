"""Surrogates for personal data, in SQL functions only.

Detected entities (e-mail addresses, IPv4 addresses, payment cards with a valid check
digit, phone numbers, names after a title) get keyed replacements of the same type and
format. One entity has one surrogate in the whole corpus, whatever its layout, so
references stay linked, and different entities have different surrogates.

Of digits in a row, all parts between separators are tried: cards in usual layouts, the
whole row as a card, phones (first those with one kind of separator, then the longest),
and cards in other layouts. Digits around them stay.

Numbers go through a keyed Feistel permutation of their digits (or of the address's
32 bits), so two numbers of one length never meet; punctuation stays, cards keep the
first digit and get a valid check digit, phones keep what stands before the last nine
digits. E-mail addresses keep the pattern of letters, digits and signs and end in the
reserved ``.example``; one domain has one surrogate. Names keep title, case and script,
and their endings follow the title's gender; given and family names are entities of
their own, so a family name alone stays linked. A name goes on over all capitalised words
after the title, with particles and initials, which stay; the last one is
the family name. Words of a row's names are replaced in the rest of its text as well,
where they are capitalised; each such mention counts as an entity. All distinct entities are checked for
equal surrogates: those after the first get a numbered form, and what still meets gets
a long hash form.

Only rows with an entity are stored and shuffled. Defined results: null text stays null;
rows are rewritten one by one, whatever their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaflow.llm.tables import keep

# Possessive repetitions, and starts that no earlier start could have passed by: a text of
# any length is searched in time linear in it, and without recursion.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{8,15})(?![0-9])"
MALE = r"Mr|Mister|Herr|Monsieur|Señor|Господин"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Госпожа"
PARTICLE = r"(?:de|del|della|der|den|da|di|do|dos|du|van|von|vom|zu|zum|zur|la|le|ten|ter|al|bin|ibn|y)"
_PART = r"(?:['-](?!s(?!\p{L}))\p{L}++)"
_WORD = rf"\p{{Lu}}\p{{L}}++{_PART}*+|\p{{Lu}}{_PART}++"
_LINKS = rf"(?:(?:{PARTICLE}|\p{{Lu}}\.) )*+"
NAME = rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? {_LINKS}(?:{_WORD})(?: {_LINKS}(?:{_WORD}))*+"
# Digits with spaces and hyphens, in which cards and phones are looked for. The last
# group is left to an address or a dotted phone that begins with it.
RUN = r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){8})[0-9][0-9 -]*(?<=[0-9])(?![0-9]|[A-Za-z0-9._%+-]{0,64}@)(?!(?<=[ -][0-9]{1,4})\.[0-9]{1,4}[. -][0-9])"
LAYOUT = r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}"
ENTITY = "|".join((EMAIL, IP, RUN, PHONE, NAME))

ROUNDS = 6
LATIN = ("ba", "be", "bri", "da", "del", "do", "fa", "fen", "ga", "gor", "ha", "hel", "jo", "ka", "kel", "la", "lin", "lo", "ma", "mer", "mo", "na", "nel", "pa", "per", "ra", "ren", "ro", "sa", "sel", "ta", "vel")
CYRILLIC = ("ба", "бе", "бри", "да", "дел", "до", "фа", "фен", "га", "гор", "ха", "хел", "жо", "ка", "кел", "ла", "лин", "ло", "ма", "мер", "мо", "на", "нел", "па", "пер", "ра", "рен", "ро", "са", "сел", "та", "вел")
ENDINGS = {("male", "latin"): ("n", "s", "r", "k"), ("female", "latin"): ("na", "la", "ra", "ssa"), ("male", "cyrillic"): ("н", "с", "р", "к"), ("female", "cyrillic"): ("на", "ла", "ра", "сса"), ("any", "latin"): ("son", "ley", "ton", "ford"), ("any", "cyrillic"): ("енко", "ич", "ман", "ко")}

_COMPONENT = "array<struct<kind:string,canon:string,raw:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` repeats it per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Check sum of all digits, the last one counting once."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * (1 + F.pmod(n - i, F.lit(2))))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))


def _is_card(text: Column) -> Column:
    return F.rlike(text, F.lit(rf"\A{CARD}\z")) & (F.pmod(_luhn_sum(_digits(text)), F.lit(10)) == 0)


def _numbers_in(raw: Column) -> Column:
    """Parts of a run of digits: cards and phones, and what stands between them."""
    return _let(F.split(raw, r"(?<=[0-9])(?=[ -])|(?<=[ -])(?=[0-9])"), _numbers_among)


def _numbers_among(pieces: Column) -> Column:
    groups = F.floor((F.size(pieces) + 1) / 2).cast("int")
    text = lambda i, j: F.array_join(F.slice(pieces, 2 * i + 1, 2 * (j - i) + 1), "")

    def judged(i: Column, j: Column) -> Column:
        part = text(i, j)
        rank = (
            F.when(F.rlike(part, F.lit(rf"\A(?:{LAYOUT})\z")) & _is_card(part), 0)
            .when((i == 0) & (j == groups - 1) & _is_card(part), 1)
            .when(F.rlike(part, F.lit(rf"\A{PHONE}\z")), 2)
            .when(_is_card(part), 3)
        )
        mixed = (F.contains(part, F.lit(" ")) & F.contains(part, F.lit("-"))).cast("int")
        return F.struct(rank.alias("rank"), mixed.alias("mixed"), (-F.length(_digits(part))).alias("less"), i.alias("i"), j.alias("j"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.filter(
        F.transform(F.sequence(i, F.least(i + 18, groups - 1)), lambda j: judged(i, j)), lambda c: c["rank"].isNotNull()
    )))
    none = F.array().cast("array<struct<rank:int,mixed:int,less:int,i:int,j:int>>")
    chosen = F.aggregate(F.array_sort(every), none, lambda acc, c: F.when(
        F.exists(acc, lambda o: (o["i"] <= c["j"]) & (c["i"] <= o["j"])), acc
    ).otherwise(F.array_append(acc, c)))

    return _let(chosen, lambda chosen: _parts_of(pieces, chosen, text))


def _parts_of(pieces: Column, chosen: Column, text) -> Column:
    digits = lambda t: _digits(t)

    def part(k: Column) -> Column:
        over = F.get(F.filter(chosen, lambda c: (2 * c["i"] <= k) & (k <= 2 * c["j"])), F.lit(0))
        whole = text(over["i"], over["j"])
        phone = over["rank"] == 2
        canon = F.when(phone, F.regexp_replace(digits(whole), r"\A1(?=[0-9]{10}\z)", "")).otherwise(digits(whole))
        named = F.struct(F.when(phone, "phone").otherwise("card").alias("kind"), canon.alias("canon"), whole.alias("raw"))
        plain = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("canon"), F.get(pieces, k).alias("raw"))
        return F.when(over.isNull(), plain).when(2 * over["i"] == k, named)

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), part), lambda x: x.isNotNull())


def _components(raw: Column) -> Column:
    """What a match consists of: ``kind, canon, raw`` of each component."""
    part = lambda kind, canon, text: F.struct(F.lit(kind).cast("string").alias("kind"), canon.alias("canon"), text.alias("raw"))
    script = F.when(F.rlike(raw, F.lit(r"\p{IsCyrillic}$")), "cyrillic").otherwise("latin")
    gender = F.when(F.rlike(raw, F.lit(rf"\A(?:{FEMALE})\.? ")), "female").otherwise("male")
    named = lambda kind, text: F.struct(kind.alias("kind"), F.lower(text).alias("canon"), text.alias("raw"))
    kinds = F.struct(
        F.split(raw, " ").alias("words"), F.concat_ws(":", F.lit("name"), F.lit("any"), script).alias("family"),
        F.concat_ws(":", F.lit("name"), gender, script).alias("given"),
    )
    name = _let(kinds, lambda x: F.transform(x["words"], lambda w, i: (
        F.when((i == 0) | F.rlike(w, F.lit(rf"\A(?:{PARTICLE}|\p{{Lu}}\.)\z")), part(None, F.lit(None).cast("string"), w))
        .when(i == F.size(x["words"]) - 1, named(x["family"], w)).otherwise(named(x["given"], w))
    )))
    digits = _digits(raw)
    return (
        F.when(F.contains(raw, F.lit("@")), F.array(part("email", F.lower(raw), raw)))
        .when(F.rlike(raw, F.lit(r"\A\p{L}")), name)
        .when(F.rlike(raw, F.lit(rf"\A{IP}\z")), F.array(part("ip", raw, raw)))
        .when(F.rlike(raw, F.lit(r"\A[0-9][0-9 -]*\z")) & (F.length(digits) > 8), _numbers_in(raw))
        .when(F.rlike(raw, F.lit(rf"\A{PHONE}\z")), F.array(part("phone", F.regexp_replace(digits, r"\A1(?=[0-9]{10}\z)", ""), raw)))
        .otherwise(F.array(part(None, F.lit(None).cast("string"), raw)))
    ).cast(_COMPONENT)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _permuted(entities: DataFrame, key: str) -> DataFrame:
    """Numbers with ``made``: fixed head, permuted body, check digit."""
    n = F.length("canon")
    kind, canon = F.col("kind"), F.col("canon")
    head = F.when(kind == "card", 1).otherwise(F.greatest(F.lit(1), n - 9))
    body = F.when(kind == "card", F.substr(canon, F.lit(2), n - 2)).otherwise(F.substr(canon, head + 1))
    half = F.floor(F.length("body") / 2).cast("int")
    octet = lambda i: F.get(F.split("canon", r"\."), F.lit(i)).cast("long")
    ip = kind == "ip"
    rows = entities.withColumns({"body": F.when(ip, "").otherwise(body), "head": F.when(ip, "").otherwise(F.substr(canon, F.lit(1), head))})
    rows = rows.withColumn("half", half).withColumns({
        "l": F.when(ip, octet(0) * 256 + octet(1)).otherwise(F.coalesce(F.try_to_number(F.substr("body", F.lit(1), F.col("half")), F.lit("9" * 18)).cast("long"), F.lit(0))),
        "r": F.when(ip, octet(2) * 256 + octet(3)).otherwise(F.substr("body", F.col("half") + 1).cast("long")),
        "ml": F.when(ip, 65536).otherwise(F.pow(F.lit(10.0), F.col("half"))).cast("long"),
        "mr": F.when(ip, 65536).otherwise(F.pow(F.lit(10.0), F.length("body") - F.col("half"))).cast("long"),
    })
    for step in range(ROUNDS):
        src, dst, mod = ("r", "l", "ml") if step % 2 == 0 else ("l", "r", "mr")
        secret = F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(step)), "kind", "head", F.col(src).cast("string")), 256)
        rows = rows.withColumn(dst, F.pmod(F.col(dst) + F.pmod(_number(F.left(secret, F.lit(12))), F.col(mod)), F.col(mod)))
    left = F.when(F.col("half") > 0, F.lpad(F.col("l").cast("string"), F.col("half"), F.lit("0"))).otherwise("")
    right = F.lpad(F.col("r").cast("string"), F.length("body") - F.col("half"), F.lit("0"))
    rows = rows.withColumn("digits", F.concat("head", left, right))
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat("digits", F.lit("0"))), F.lit(10)), F.lit(10))
    address = F.concat_ws(".", *[F.shiftright(F.col(c), s).bitwiseAND(F.lit(255)).cast("string") for c in "lr" for s in (8, 0)])
    made = F.when(ip, address).when(kind == "card", F.concat("digits", check.cast("string"))).otherwise(F.col("digits"))
    return rows.select("kind", "canon", made.alias("made"))


def _like(text: Column, secret: Column) -> Column:
    """``text`` with letters and digits drawn anew from the hex string ``secret``."""
    return _let(secret, lambda secret: _drawn(text, secret))


def _drawn(text: Column, secret: Column) -> Column:
    chars = F.split(text, "")
    drawn = lambda i: _number(F.substr(secret, F.pmod(i * 3, F.lit(120)) + 1, F.lit(3)))
    letter = lambda i, first, size: F.char(F.lit(first) + F.pmod(drawn(i), F.lit(size)))
    return F.array_join(F.transform(chars, lambda c, i: (
        F.when(F.rlike(c, F.lit("[a-z]")), letter(i, 97, 26)).when(F.rlike(c, F.lit("[0-9]")), letter(i, 48, 10)).otherwise(c)
    )), "")


def _pick(options: tuple[str, ...], number: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(number, F.lit(len(options))).cast("int"))


def _worded(entities: DataFrame, key: str) -> DataFrame:
    """E-mail addresses and names with ``made``, and ``form`` for repeated ones."""
    secret = lambda what: F.concat(*[F.sha2(F.concat_ws("|", F.lit(f"{key}|{n}"), what), 256) for n in (1, 2)])
    rows = entities.withColumn("secret", secret(F.concat_ws("|", "kind", "canon")))
    local, domain = F.substring_index("canon", "@", 1), F.regexp_replace(F.substring_index("canon", "@", -1), r"\.[^.]*\z", "")
    email = F.concat(_like(local, F.col("secret")), F.lit("@"), _like(domain, secret(F.concat_ws("|", F.lit("domain"), domain))), F.lit(".example"))
    at = lambda i: _number(F.substr("secret", F.lit(4 * i + 1), F.lit(4)))
    cyrillic = F.endswith("kind", F.lit("cyrillic"))
    more = F.length("canon") > 6
    syllables = [F.when(cyrillic, _pick(CYRILLIC, at(i))).otherwise(_pick(LATIN, at(i))) for i in range(3)]
    ending = F.lit("")
    for (gender, script), options in ENDINGS.items():
        ending = F.when(F.col("kind") == f"name:{gender}:{script}", _pick(options, at(3))).otherwise(ending)
    name = F.concat(syllables[0], syllables[1], F.when(more, syllables[2]).otherwise(""), ending)
    return rows.select("kind", "canon", F.when(F.col("kind") == "email", email).otherwise(name).alias("made"), "secret")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, made`` of distinct entities, with no surrogate given twice."""
    numbers = _permuted(entities.filter(F.col("kind").isin("ip", "card", "phone")), key)
    words = _worded(entities.filter(~F.col("kind").isin("ip", "card", "phone")), key)
    family = F.when(F.startswith("kind", F.lit("name:")), "name").otherwise(F.col("kind"))
    place = lambda c: F.row_number().over(Window.partitionBy(family, c).orderBy("canon", "kind")) - 1
    letters = lambda c: F.translate(c.cast("string"), "0123456789", "abdefghiko")
    numbered = lambda r: F.when(r == 0, F.col("made")).when(
        F.col("kind") == "email", F.concat(F.substring_index("made", "@", 1), F.lit("-"), letters(r), F.lit("@"), F.substring_index("made", "@", -1))
    ).otherwise(F.concat("made", letters(r)))
    once = words.withColumn("_r", place(F.col("made"))).withColumn("form", numbered(F.col("_r")))
    long_form = F.concat(F.lit("x"), F.translate("secret", "0123456789", "ghijklmnop"))
    again = F.when(F.col("kind") == "email", F.concat(F.left(long_form, F.lit(40)), F.lit("@hidden.example"))).otherwise(F.left(long_form, F.lit(40)))
    twice = once.withColumn("_r", place(F.col("form")))
    checked = twice.select("kind", "canon", F.when((F.col("_r") == 0) & (F.col("form") != F.col("canon")), F.col("form")).otherwise(again).alias("made"))
    return numbers.union(checked)


def _laid_out(raw: Column, made: Column, kind: Column) -> Column:
    """A surrogate in the layout and case of the match it replaces."""
    # A leading country digit that the surrogate lacks stays.
    extra = F.length(_digits(raw)) - F.length(made)
    nth = lambda i: F.length(_digits(F.substr(raw, F.lit(1), i + 1))) - extra
    digit = F.transform(F.split(raw, ""), lambda c, i: (
        F.when(F.rlike(c, F.lit("[0-9]")) & (nth(i) > 0), F.substr(made, nth(i), F.lit(1))).otherwise(c)
    ))
    cased = F.when(raw == F.upper(raw), F.upper(made)).otherwise(F.concat(F.upper(F.left(made, F.lit(1))), F.substr(made, F.lit(2))))
    return (
        F.when(made.isNull(), raw).when(kind.isin("card", "phone"), F.array_join(digit, ""))
        .when(F.startswith(kind, F.lit("name:")), cased).otherwise(made)
    )


def _mentions(gap: Column, names: Column) -> Column:
    """Text between matches with words of ``names`` replaced: ``text`` and the number of mentions."""
    words = F.split(gap, r"(?<=\p{L})(?!['-]?\p{L})|(?<=\p{L})(?=['-]s(?!\p{L}))|(?<![\p{L}])(?<!\p{L}['-])(?=\p{L})")
    made = lambda w: F.when(F.rlike(w, F.lit(r"\A\p{Lu}")), F.get(F.filter(names, lambda n: n["canon"] == F.lower(w)), F.lit(0)))
    found = F.transform(words, lambda w: F.struct(w.alias("raw"), made(w).alias("name")))
    text = F.array_join(F.transform(found, lambda x: F.when(x["name"].isNull(), x["raw"]).otherwise(_laid_out(x["raw"], x["name"]["made"], x["name"]["kind"]))), "")
    # Words with one space between them are one mention.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("near"))
    count = F.aggregate(found, start, lambda acc, x: F.struct(
        (acc["n"] + F.when(x["name"].isNotNull() & (acc["near"] == 0), 1).otherwise(0)).alias("n"),
        F.when(x["name"].isNotNull(), 2).when((acc["near"] == 2) & (x["raw"] == " "), 1).otherwise(0).alias("near"),
    ), lambda acc: acc["n"])
    return F.struct(text.alias("text"), count.alias("n"))


def replace_entities(documents: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_entities`` of every row, with surrogates in the text."""
    has = F.coalesce(F.rlike("text", F.lit(ENTITY)), F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    clean = rows.filter(~has).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"))
    hits = rows.filter(has).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    hits, _ = keep(hits, "entities")
    matches = hits.select("row", F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).alias("pos", "raw"))
    parts = matches.select("row", "pos", F.posexplode(_components(F.col("raw"))).alias("sub", "c")).select("row", "pos", "sub", "c.*")
    known = parts.filter(F.col("kind").isNotNull()).select("kind", "canon").distinct()
    table, _ = keep(surrogates(known, key), "surrogates")
    named = parts.join(table, ["kind", "canon"], "left")
    piece = F.struct("sub", _laid_out(F.col("raw"), F.col("made"), F.col("kind")).alias("text"))
    one = named.groupBy("row", "pos").agg(
        F.sort_array(F.collect_list(piece)).alias("p"), F.count("kind").alias("real"), F.max(F.startswith("kind", F.lit("name:"))).alias("name")
    )
    text = F.when(F.col("name"), F.array_join(F.col("p.text"), " ")).otherwise(F.array_join(F.col("p.text"), ""))
    filled = one.select("row", F.when(F.col("name"), 1).otherwise(F.col("real")).alias("real"), F.struct("pos", text.alias("text")).alias("m"))
    by_row = filled.groupBy("row").agg(F.sort_array(F.collect_list("m")).alias("m"), F.sum("real").alias("n_entities"))
    is_name = F.startswith("kind", F.lit("name:"))
    names = named.filter(is_name).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("kind", "canon", "made"))).alias("names"))
    gaps = F.split("text", ENTITY, -1)
    rest = F.transform(gaps, lambda g: F.when(F.col("names").isNull(), F.struct(g.alias("text"), F.lit(0).alias("n"))).otherwise(_mentions(g, F.col("names"))))
    both = hits.join(by_row, "row").join(names, "row", "left").withColumn("rest", rest)
    woven = _let(F.col("m.text"), lambda made: F.array_join(
        F.transform("rest", lambda g, i: F.concat(g["text"], F.coalesce(F.get(made, i), F.lit("")))), ""
    ))
    more = F.aggregate("rest", F.lit(0).cast("long"), lambda n, g: n + g["n"])
    changed = both.select("doc_id", woven.alias("text"), (F.col("n_entities") + more).alias("n_entities"))
    return clean.union(changed)
