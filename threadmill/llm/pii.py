"""Personal information in free text: bootstrapped contextual extraction, and typed placeholders.

One pass takes candidate mentions with their contexts: emails by the way they write the signs in them, addresses by
their kind of street, numbers by shape (digits masked), and pairs of words of which one is rare in the corpus (a
surname), with the words before and after and the ending as patterns. Seeds are entities whose form alone says what
they are: emails with plain signs, addresses with a street word in full, numbers with an international prefix or in the
form of a public identity number, titles before a name; words of sentences are seeds of what is no name. Then scores go back and forth between instances (forms, shapes,
first names) and patterns over their counted edges: patterns that seeds stand in gain, instances in such patterns gain,
and so on until the scores converge, so that unseen forms, shapes and names are scored; all counts cover the whole
corpus. A mention counts if its instance scores, or if its patterns do.

The words that are common in the corpus are broadcast: a word is common if it is in more than COMMON of the distinct
texts, so there are at most (words per text) / COMMON of them, whatever the size of the corpus. Names with a common word
teach nothing, but count where what was learned from the others says so: beside a first name that scores, and beside a
title or before a comma if the word follows such a first name somewhere. An address that reads as a phrase (a common
word in small letters) counts if the pattern before it scores.

All counts are over distinct texts, so copies of a text change nothing.

Defined results: null and empty texts have no mentions; repeated rows give their mentions once; full-width forms count
as their plain forms and zero-width characters are passed over; names within an email or street address don't count;
a corpus without any seed has no mentions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..session import cut_lineage

#: Share of documents beyond which a word is common; rise of all scores below which they have converged, rounds at most;
#: least score of an instance.
COMMON, CONVERGED, ROUNDS, LEAST = 0.0012, 0.005, 30, 0.5

#: Edges of the graph in a partition.
EDGES = 50_000

#: Titles before a name, and forms that say by themselves what an entity is: plain or bracketed signs of an email, street
#: words in full, international prefixes, and shapes of public identity numbers; words that announce a number (fixed values).
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "don", "doña", "señor", "señora", "sr", "sra", "mme", "mlle", "monsieur", "madame", "pan", "pani", "sir"}
SEED_EMAILS = ("@ .", "(at) (dot)", "[at] (dot)", "{at} (dot)")
SEED_STREETS = (
    "street", "road", "lane", "avenue", "boulevard", "close", "way", "drive", "court", "place", "square", "terrace", "crescent", "gardens", "straße", "strasse", "gasse", "weg", "allee", "platz", "ring", "ufer",
    "rue", "chemin", "allée", "impasse", "quai", "calle", "avenida", "plaza", "paseo", "ulica", "ul.", "aleja", "osiedle", "plac", "丁目",
)
SEED_PHONES = r"^\(?\+|^009{2} |^009{2}-9{2,3}-9"
SEED_IDS = ("999-99-9999", "AA 99 99 99 A", "AA999999A", "99999999-A", "A9999999A", "9 99 99 99 999 999 99", "99999999999", "AAA999999", "A99A99A99", "AA9999999", "9999-9999-9999")
SEED_WORDS = {
    "phone": ("tel", "tél", "tfno", "call", "phone", "mobile", "telefon", "teléfono", "téléphone", "fax", "電話"),
    "id_number": ("passport", "pasaporte", "passeport", "reisepass", "paszport", "旅券", "ausweisnummer", "pesel", "nino", "dni"),
}
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "name": "[NAME]"}

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | dict.fromkeys((0xA0, 0x2002, 0x2003, 0x2009, 0x202F, 0x3000), 32) | dict.fromkeys((0x2010, 0x2011, 0x2212), 45)
_IS_WIDE = re.compile(f"[{re.escape(''.join(map(chr, _WIDE)))}]")
_HIDDEN = re.compile("[­​-‏⁠﻿]")

_AT = r"\s?(?:@|\(at\)|\[at\]|\{at\})\s?"
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\{dot\})\s?)"
_EMAIL = re.compile(rf"(?i)(?<![a-z0-9._%+-])[a-z0-9](?:[a-z0-9._%+-]*[a-z0-9_])?{_AT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*{_DOT}[a-z]{{2,24}}(?![a-z0-9])")
_URL = re.compile(r"(?i)\b(?:https?|ftp)://\S+|(?<![\w.])@\w+|\b[\w.-]+@v\d[\d.]*")
_TYPES = r"street|str|st|road|rd|lane|ln|avenue|ave|boulevard|blvd|close|way|drive|court|place|square|terrace|crescent|gardens"
_STREETS = [re.compile(p) for p in (
    rf"(?i)\b(?:flat \d+[a-z]?,? )?\d{{1,4}}[a-z]? (?P<w>[^\W\d_][\w'’-]+)(?: [^\W\d_][\w'’-]+)? (?P<t>{_TYPES})\b\.?(?:,? (?:apt|flat|unit|suite)\.? ?\d+[a-z]?)?",
    r"(?i)(?<!\w)(?P<w>[^\W\d_][\w'’]{2,}-?(?P<t>straße|strasse|str\.|gasse|weg|allee|platz|ring|ufer)|[^\W\d_]\w+(?:-| )(?P<t2>allee)) \d{1,4} ?[a-z]?\b",
    r"(?i)\b\d{1,4}(?: bis| ter| quater)?,? (?P<t>rue|avenue|av\.|bd|boulevard|place|chemin|allée|impasse|quai)(?: de la| de| du| des| d['’])? ?(?P<w>[^\W\d_][\w'’-]+)",
    r"(?i)(?<!\w)(?P<t>calle|c/|avda\.?|avenida|plaza|pza\.?|paseo)\s*(?:de )?(?P<w>[^\W\d_][\w'’-]+),? (?:n\.º ?)?\d{1,4}",
    r"(?i)(?<!\w)(?P<t>ul\.|ulica|aleja|al\.|os\.|osiedle|plac|pl\.)\s*(?P<w>[^\W\d_][\w'’-]+) \d{1,4}[a-z]?(?:/\d+)?",
    r"(?:〒 ?\d{3}-\d{4} ?)?[一-鿿]{1,4}[市区町村郡][一-鿿]{0,6}?\d{1,3}(?:(?P<t>丁目)\d{1,3}番地?(?:\d{1,3}号?)?|(?P<t2>-)\d{1,3}-\d{1,3})",
)]
#: What a text must hold for the pattern of the same place to be tried.
_STREET_SIGNS = (
    tuple(f" {t}" for t in _TYPES.split("|")), ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "ufer"), ("rue", "avenue", "av.", "bd", "boulevard", "place", "chemin", "allée", "impasse", "quai"),
    ("calle", "c/", "avda", "avenida", "plaza", "pza", "paseo"), ("ul.", "ulica", "aleja", "al.", "os.", "osiedle", "plac", "pl."), tuple("市区町村郡"),
)
_HAS_DIGIT, _SEPARATOR = re.compile(r"\d"), re.compile(rf"(?i){_AT}")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_#§$€£〒])(?<![\d][.,:/-])(?:\(?\+\d|\(\d|(?:[A-Z]{1,3} ?)?\d)(?:[ ./()-]{0,2}(?:\d|[A-Z]{1,3}(?![A-Za-z'’])))*(?![A-Za-z0-9_@]|[.,:/-]\d)")
_L = r"[^\W\d_\u3040-\u30ff\u3400-\u9fff々]"  # letters of scripts that part words
_WORD = re.compile(rf"(?<![A-Za-z0-9_@]){_L}+(?:['’]{_L}+)*(?:-{_L}+)*")
_LATIN = re.compile(r"[^\W\d_]*[a-zÀ-ɏ][^\W\d_]*")
_KANJI = re.compile(r"([一-鿿々]{1,3} [一-鿿々]{2,3}?|[一-鿿々]{3,6}?)(氏|さん|様|(?=[^一-鿿々]))")
_GAP, _NEXT = re.compile(r"\.? +"), re.compile(r"[ ,]*([^\W\d_]{1,3}(?=[^\W\d_]*[ぁ-ヿ一-鿿])|[^\W\d_]+)")

MENTIONS = "doc_id string, slot string, form string, l string, r string, s string, kind string, w string, start int, stop int"


def fold(text: str) -> tuple[str, list[int] | None]:
    """text in plain forms, and the place in text of each of its characters (None: the same places)."""
    if text.isascii():
        return text, None
    if _IS_WIDE.search(text):
        text = text.translate(_WIDE)
    if not _HIDDEN.search(text):
        return text, None
    places = [i for i, c in enumerate(text) if not _HIDDEN.match(c)]
    return "".join(text[i] for i in places), places


def shape(number: str) -> str:
    """A number's shape: letters A, digits 9, up to two leading zeros kept."""
    zeros = re.match(r"(\(?)(0{1,2})", number)
    head = zeros[0] if zeros else ""
    return head + re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", number[len(head):]))


def _before(text: str, at: int) -> list[str]:
    """Up to three words right before a place, latest last; none if a sentence or bracket lies between."""
    left = re.split(r"[.!?。\n(\[<;—](?:\s|$)|[(\[<]", text[max(0, at - 48) : at].replace("n.º", "n_º").replace("Tel.", "Tel").replace("tel.", "tel").replace("tél.", "tél"))[-1]
    words = re.findall(r"[^\W\d_]+[_º]*[^\W\d_]*", left.casefold())
    if words and re.search(r"[一-鿿ぁ-ヿ]", words[-1]):
        m = re.search(r"[一-鿿]+$", words[-1])
        return [m[0] if m else words[-1][-3:]]
    return [w.replace("_", ".") for w in words[-4:]]


def _after(text: str, at: int) -> str:
    """The word right after a place, if nothing but blanks and commas lies between."""
    m = _NEXT.match(text, at)
    return m[1].casefold() if m else ""


def _titled(word: str) -> bool:
    return word[0].isupper() and not word[1:].isupper()


def mentions_in(text: str, common: set[str], proper: set[str] = frozenset()) -> Iterator[tuple]:
    """(slot, form, l, r, s, kind, w, start, stop) of a text's mentions; kind where the form alone says it.

    common are the common words, proper those of them that are mostly written with a capital. The kind of a name with a
    common word is 'late', of one with a common first word 'common', or 'plain' if that is mostly written small.
    """
    plain, places = fold(text)
    spot = (lambda a, b: (a, b)) if places is None else (lambda a, b: (places[a], places[b - 1] + 1))
    now, low = plain, plain.casefold()
    digits_in = _HAS_DIGIT.search(plain) is not None

    def hide(a: int, b: int) -> None:
        nonlocal now
        now = f"{now[:a]}{chr(0) * (b - a)}{now[b:]}"

    if "@" in low or "at)" in low or "at]" in low or "at}" in low:
        for m in _EMAIL.finditer(plain):
            sign = _SEPARATOR.search(m[0])
            form = f"{sign[0].casefold() if '@' in sign[0] else sign[0].casefold().strip()} {'.' if '.' in m[0][sign.end():] else '(dot)'}"
            yield "mail", form, " ".join(_before(plain, m.start())[-1:]), _after(plain, m.end()), None, "email", None, *spot(*m.span())
            hide(*m.span())
    if "@" in low or "://" in low:
        for m in _URL.finditer(plain):
            hide(*m.span())
    if digits_in:
        for p, signs in zip(_STREETS, _STREET_SIGNS):
            if not any(x in low for x in signs):
                continue
            for m in p.finditer(now):
                g = m.groupdict()
                w, t = g.get("w"), (g.get("t") or g.get("t2") or "").casefold()
                word = w.casefold() if w else None
                phrase = bool(w) and word in common and word not in proper and not _titled(w)
                yield "phrase" if phrase else "street", f"phrase {t}" if phrase else t, " ".join(_before(now, m.start())[-1:]), _after(now, m.end()), None, "street_address", None, *spot(*m.span())
                if not phrase:
                    hide(*m.span())
        for m in _NUMBER.finditer(now):
            raw = m[0].rstrip(" ./(-")
            if raw.count("(") < raw.count(")"):
                raw = raw.rstrip(")")
            start = m.start()
            if raw.startswith("(") and ")" not in raw:
                raw, start = raw[1:], start + 1
            digits = sum(c.isdigit() for c in raw)
            if not 6 <= digits <= 16:
                continue
            words = _before(now, start)
            yield "num", shape(raw), " ".join(words[-1:]), " ".join(words[-2:]) if len(words) > 1 else "", None, None, None, *spot(start, start + len(raw))
    words = [(m.start(), m.end(), m[0].casefold()) for m in _WORD.finditer(now)]
    n = len(words)
    for i in range(n):
        a, b, w = words[i]
        late = w in common
        if late and w not in proper and not _titled(now[a:b]) or len(w) < 4 or w in TITLES or not _LATIN.fullmatch(w.replace("-", "").replace("'", "").replace("’", "")):
            continue
        after = lambda k: words[k][2] if k < n and re.fullmatch(r"[ ,:]*", now[words[k - 1][1] : words[k][0]]) else "|"
        back = lambda k: words[k][2] if k >= 0 and re.fullmatch(r"[ ,:]*", now[words[k][1] : words[k + 1][0]]) else "|"
        ending = w[-4:]
        h, middle = i - 1, False
        if h >= 0 and _GAP.fullmatch(now[words[h][1] : a]):
            if len(words[h][2]) == 1 and now[words[h][1]] == "." and h >= 1 and len(words[h - 1][2]) > 2 and now[words[h - 1][0]].isupper() and _GAP.fullmatch(now[words[h - 1][1] : words[h][0]]) and "." not in now[words[h - 1][1] : words[h][0]] and not (words[h - 1][2] in common and words[h - 1][2] not in proper):
                h, middle = h - 1, True  # a middle initial
            head = words[h][2]
            dot = "." in now[words[h][1] : words[h + 1][0]]
            cased = now[a].isupper() or not now[words[h][0]].isupper()  # a name's parts are written alike
            plain_head = late and head in common and head not in proper and head not in TITLES  # a word of the sentence
            if cased and not plain_head and (dot if len(head) == 1 else head in TITLES or not dot):
                yield "name", "<initial>" if len(head) == 1 else head, "<middle>" if middle else back(h - 1), after(i + 1), ending, "late" if late else None if head not in common else "common" if head in proper or head in TITLES or len(head) == 1 else "plain", w, *spot(words[h][0], b)
        if i + 1 < n and re.fullmatch(r", ", now[b : words[i + 1][0]]) and words[i + 1][2] not in TITLES and len(words[i + 1][2]) > 1:
            yield "name", words[i + 1][2], back(i - 1), after(i + 2), ending, "late" if late else None, w + ",", *spot(a, words[i + 1][1])
    for m in () if now.isascii() else _KANJI.finditer(now):
        run = m[1].replace(" ", "")
        title, follows = m[2], now[m.end(1) : m.end(1) + 1]
        for k in (2, 3):
            if len(run) > k:
                yield "name", run[-k:], "", "<title>" if title else follows, None, None, None, *spot(*m.span(1))


def common_words(texts: DataFrame, share: float = COMMON) -> tuple[list[str], list[str]]:
    """Words in more than share of the distinct texts (and in more than three), and those of them that mostly have a capital."""
    raw = F.regexp_extract_all("text", F.lit(r"(?U)[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+(?:['’-][\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]+)*"), 0)
    n = texts.count()
    words = texts.select(raw.alias("raw")).select("raw", F.array_distinct(F.transform("raw", F.lower)).alias("low"))
    seen = words.select(F.explode(F.concat(
        F.transform("low", lambda w: F.struct(w.alias("w"), F.lit(False).alias("is_low"))), F.transform(F.array_intersect("low", "raw"), lambda w: F.struct(w.alias("w"), F.lit(True).alias("is_low")))
    )).alias("x")).groupBy("x.w").agg(F.count_if(~F.col("x.is_low")).alias("n"), F.count_if("x.is_low").alias("n_low"))
    rows = seen.filter(F.col("n") > max(3, share * n)).select("w", (F.col("n_low") * 2 < F.col("n")).alias("is_proper")).collect()
    return sorted(r.w for r in rows), sorted(r.w for r in rows if r.is_proper)


def mentions(texts: DataFrame, common: list[str], proper: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((frozenset(common), frozenset(proper)))
    names = [c.split(" ")[0] for c in MENTIONS.split(", ")]
    kinds = (*[pa.string()] * 8, pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.extend((doc, *m) for m in mentions_in(text, *words))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return texts.mapInArrow(run, MENTIONS)


@contextmanager
def _fixed_plans(spark, partitions: int) -> Iterator[None]:
    """Plans made inside have so many partitions, and none is planned anew while it runs: rounds are alike, and their
    tables lie where the joins need them."""
    new = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    was = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, eps: float = CONVERGED) -> tuple[DataFrame, DataFrame]:
    """Scores of forms (kind, form, score) and patterns (kind, part, pattern, p), in rounds until their sum rises by less than a share of eps.

    edges: kind, form, part, pattern, n, and form_seed and pattern_seed, the scores of seeds (null for others), which
    stay. A pattern's score is the mean score of the forms in it, held back by one; a form's score joins (noisy-or) the
    mean scores of its patterns of each part. Edges lie ready in the partitions of their forms and of their patterns, so
    a round moves partial sums only.
    """
    size = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_form, by_pattern = ["kind", "form"], ["kind", "part", "pattern"]
    of_form = cut_lineage(edges.select(*by_pattern, "form", "n", "pattern_seed").repartition(size, *by_form))
    of_pattern = cut_lineage(edges.select(*by_pattern, "form", "n", "form_seed").repartition(size, *by_pattern))
    forms = edges.groupBy(*by_form).agg(F.coalesce(F.max("form_seed"), F.lit(0.0)).alias("score"))
    sums = lambda p: (F.sum(F.when(F.col("part") == p, F.col("n") * F.col("p"))), F.sum(F.when(F.col("part") == p, F.col("n"))))
    patterns_of = lambda forms: of_form.join(forms.withColumnRenamed("score", "s").hint("shuffle_hash"), by_form).groupBy(*by_pattern).agg(
        F.coalesce(F.max("pattern_seed"), F.sum(F.col("n") * F.col("s")) / (F.sum("n") + 1)).alias("p")
    )
    total = None
    for _ in range(rounds):
        for _ in range(2):  # two rounds for each look at how far scores rose
            none = F.lit(1.0)
            for part in "lrs":
                top, n = sums(part)
                none = none * F.greatest(1 - F.coalesce(top / n, F.lit(0.0)), F.lit(1e-6))
            forms = of_pattern.join(patterns_of(forms).hint("shuffle_hash"), by_pattern).groupBy(*by_form).agg(F.coalesce(F.max("form_seed"), 1 - none).alias("score"))
        seen = Observation()
        forms = cut_lineage(forms.observe(seen, F.sum("score").alias("total")))
        was, total = total, seen.get["total"] or 0.0
        if was is not None and total - was <= eps * total:  # from no scores but the seeds', scores only rise
            break
    return forms, cut_lineage(patterns_of(forms))


def seed_of(kind: str) -> Column:
    """The score of a form that is a seed by itself, else null."""
    form = F.col("form")
    plain = F.concat(F.regexp_replace(F.regexp_extract("form", "^0{1,2}", 0), "0", "9"), F.regexp_replace("form", "^0{1,2}", ""))
    is_seed = {"email": form.isin(*SEED_EMAILS), "street_address": form.isin(*SEED_STREETS), "phone": form.rlike(SEED_PHONES), "id_number": plain.isin(*SEED_IDS)}
    return F.when(is_seed[kind], 1.0)


def _edges(m: DataFrame) -> DataFrame:
    """Counted edges between forms and their patterns, with seeds."""
    part = lambda p: F.struct(F.lit(p).alias("part"), F.col(p).alias("pattern"))
    kinds = F.when(F.col("slot") == "num", F.array(F.lit("phone"), F.lit("id_number"))).otherwise(F.array("kind"))
    out = m.filter("slot <> 'name'").select(F.explode(kinds).alias("kind"), "form", F.array(part("l"), part("r")).alias("e")).select("kind", "form", F.explode("e").alias("e"))
    form_seed, pattern_seed = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind in ("email", "street_address", "phone", "id_number"):
        form_seed = F.when(F.col("kind") == kind, seed_of(kind)).otherwise(form_seed)
        if kind in SEED_WORDS:
            pattern_seed = F.when((F.col("kind") == kind) & (F.col("e.part") == "l") & F.col("e.pattern").isin(*SEED_WORDS[kind]), 1.0).otherwise(pattern_seed)
    out = out.select("kind", "form", form_seed.alias("form_seed"), pattern_seed.alias("pattern_seed"), "e")
    name = m.filter("slot = 'name' and not kind <=> 'late'").select(
        F.lit("name").alias("kind"), "form", F.when(F.col("form").isin(sorted(TITLES)), 1.0).when(F.col("form") == "<initial>", 0.6).when(F.col("kind") == "plain", 0.0).alias("form_seed"), F.lit(None).cast("double").alias("pattern_seed"),
        F.explode(F.array(*map(part, "lrs"))).alias("e"),
    )
    name = name.withColumn("pattern_seed", F.when(F.col("e.pattern").isin("<title>", "<middle>"), 1.0)).select("kind", "form", "form_seed", "pattern_seed", "e")
    return (
        out.unionByName(name).select("kind", "form", "form_seed", "pattern_seed", "e.part", "e.pattern").filter("pattern is not null and pattern not in ('', '|')")
        .groupBy("kind", "form", "part", "pattern").agg(F.count("*").alias("n"), F.max("form_seed").alias("form_seed"), F.max("pattern_seed").alias("pattern_seed"))
    )


def find(docs: DataFrame) -> DataFrame:
    """Every mention of personal information: doc_id, pii_kind, start, stop (places in the text)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text <> ''")
    texts = cut_lineage(docs.select(F.sha2("text", 256).alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    holders = docs.select(F.col("doc_id").alias("holder"), F.sha2("text", 256).alias("doc_id")).distinct()
    m = cut_lineage(mentions(texts, *common_words(texts)).distinct())
    edges = cut_lineage(_edges(m))
    spark = docs.sparkSession
    with _fixed_plans(spark, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + edges.count() // EDGES)):
        forms, patterns = bootstrap(edges)

    # emails and addresses: the form scores, or a pattern beside it does; a phrase needs the pattern before it
    at = lambda p: patterns.filter(F.col("kind").isin("email", "street_address") & (F.col("part") == p) & (F.col("p") >= LEAST)).select("kind", F.col("pattern").alias(p), F.lit(True).alias(f"p_{p}"))
    written = m.filter(F.col("slot").isin("mail", "street", "phrase"))
    own_seed = F.when(F.col("kind") == "email", seed_of("email")).otherwise(seed_of("street_address"))  # also where nothing stands beside it
    written = written.join(forms.filter("kind <> 'name'"), ["kind", "form"], "left").join(at("l"), ["kind", "l"], "left").join(at("r"), ["kind", "r"], "left")
    counts = F.when(F.col("slot") == "phrase", F.col("p_l")).otherwise((F.coalesce(own_seed, "score", F.lit(0.0)) >= LEAST) | F.coalesce("p_l", "p_r", F.lit(False)))
    own = cut_lineage(written.filter(counts).select("doc_id", F.col("kind").alias("pii_kind"), "start", "stop"))

    # numbers count by their shape, which scored in whatever contexts it has anywhere, or is a seed
    shapes = m.filter("slot = 'num'").select("form").distinct()
    seeds = shapes.select(F.lit("phone").alias("kind"), "form", seed_of("phone").alias("score")).unionByName(shapes.select(F.lit("id_number").alias("kind"), "form", seed_of("id_number").alias("score"))).filter("score is not null")
    best = forms.filter(F.col("kind").isin("phone", "id_number")).select("kind", "form", "score").unionByName(seeds)
    best = best.groupBy("form").agg(F.max(F.struct("score", "kind")).alias("x")).filter(F.col("x.score") >= LEAST)
    other = best.select(F.col("form").alias("plain_form"), F.col("x.kind").alias("plain_kind"))
    num = m.filter("slot = 'num'").join(best, "form", "left").withColumn(
        "plain_form", F.when(F.col("x").isNull(), F.concat(F.regexp_replace(F.regexp_extract("form", "^0{1,2}", 0), "0", "9"), F.regexp_replace("form", "^0{1,2}", ""))))
    num = num.join(other, "plain_form", "left")  # a shape that never has a context counts as the one without leading zeros
    numbers = cut_lineage(num.select("doc_id", F.coalesce("x.kind", "plain_kind").alias("pii_kind"), "start", "stop").filter("pii_kind is not null"))

    name = m.filter("slot = 'name'")
    scored = forms.filter("kind = 'name'").select("form", "score")
    met = cut_lineage(name.withColumn("is_common", F.col("kind").isNotNull()).withColumn("is_late", F.col("kind").eqNullSafe("late")).drop("kind").join(scored, "form"))  # read by each of the parts below
    is_known = (F.col("score") >= LEAST) & (F.col("form") != "<initial>")
    # unseen first names, and initials: the ending and a neighbour of the mention have to score, however often the form occurs
    p_of = lambda p: patterns.filter((F.col("kind") == "name") & (F.col("part") == p) & (F.col("p") >= LEAST)).select(F.col("pattern").alias(p), F.lit(1).alias(f"p_{p}"))
    unseen = met.filter(~is_known & ((F.col("form") == "<initial>") | ~F.col("is_common"))).join(p_of("s"), "s")
    unseen = cut_lineage(unseen.join(p_of("l"), "l", "left").join(p_of("r"), "r", "left").filter("p_l is not null or p_r is not null").select("doc_id", "start", "stop"))
    # a common word is a surname where it follows a first name that scores; before a comma or after a title only if it does so somewhere
    first = forms.filter((F.col("kind") == "name") & (F.col("score") >= LEAST)).select(F.col("form").alias("surname"))
    late = met.filter(is_known & F.col("is_late")).withColumn("surname", F.regexp_replace("w", ",$", "")).join(first, "surname", "left_anti")  # a first name is none
    direct = ~F.col("form").isin(sorted(TITLES)) & ~F.coalesce(F.col("w").endswith(","), F.lit(False))
    surnames = late.filter(direct).select("surname").distinct()
    late = late.filter(direct).unionByName(late.filter(~direct).join(surnames, "surname", "left_semi").select(late.columns))
    known = met.filter(is_known & ~F.col("is_late")).select("doc_id", "start", "stop").unionByName(late.select("doc_id", "start", "stop"))
    names = known.unionByName(unseen.select("doc_id", "start", "stop"))
    found = own.unionByName(numbers).unionByName(names.select("doc_id", F.lit("name").alias("pii_kind"), "start", "stop")).distinct()
    return found.join(holders, "doc_id").select(F.col("holder").alias("doc_id"), "pii_kind", "start", "stop").distinct()


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, redacted: texts with typed placeholders in place of what was found; other characters stay as they are."""
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "pii_kind"))).alias("spans"))
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(spans, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out, at = [], 0
                for i, s in enumerate(own):
                    later = own[i + 1] if i + 1 < len(own) else None
                    if s["start"] < at or later and later["start"] < s["stop"] < later["stop"]:
                        continue  # of two that overlap the later is the tighter
                    out += [text[at : s["start"]], PLACEHOLDER[s["pii_kind"]]]
                    at = s["stop"]
                texts.append("".join(out) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "redacted"])

    return d.mapInArrow(run, "doc_id long, redacted string")
