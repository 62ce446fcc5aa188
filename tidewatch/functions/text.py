"""Text functions as column expressions: normalising, tokens, hashes, similarity, languages."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# They have to be these for equal results. Words that carry no topic, as they read without accents.
SPANISH_STOP_WORDS = tuple(
    "de la que el en y a los del se las por un para con una su al es lo como mas pero sus le ya o este si porque esta entre cuando muy sin sobre tambien hasta hay donde quien desde todo nos durante todos uno les "
    "ni contra otros ese eso ante ellos e esto antes algunos unos yo otro otras otra tanto esa estos mucho quienes nada muchos cual poco ella estar estas algunas algo nosotros mi mis te ti tu tus ellas nosotras vosotros vosotras os "
    "ser son fue era han ha he hemos estan tiene tienen hacer hace hacen puede pueden solo ahi asi cada tan sera va van ir ver dice dijo".split()
)
ENGLISH_STOP_WORDS = tuple(
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my one all would there their what so up out if about who get which go me when make can like time "
    "no just him know take people into year your good some could them see other than then now look only come its over think also back after use two how our work first well way even new want because any these give day most us is are was "
    "were been has had does did doing here should very much more still being too such via per own same am it's don't you're http https www com".split()
)
STOP_WORDS = tuple(dict.fromkeys(SPANISH_STOP_WORDS + ENGLISH_STOP_WORDS))
# Marks of the two-language detector, in the order that ties follow. No text has the accent of the ninth.
LANGUAGE_MARKERS = {
    "es": (" que ", " de ", " la ", " el ", " los ", " para ", " con ", " una ", " está ", " pero ", " porque "),
    "en": (" the ", " and ", " for ", " with ", " that ", " this ", " from ", " have ", " will ", " are "),
}


@lru_cache(1)
def _fold_table() -> tuple[str, str]:
    """Letters whose accents fall off to one ASCII letter, and marks that vanish."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    source, target = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) < 0x370)
        if len(bare) == 1 and bare.isascii():
            source.append(chr(code))
            target.append(bare)
    return "".join(source + marks), "".join(target)


def normalize_text(text: Column) -> Column:
    """No accents, lower case, no addresses, only a-z 0-9 ' - and single blanks."""
    bare = F.lower(F.translate(text, *_fold_table()))
    bare = F.regexp_replace(bare, r"https?://\S+", " ")
    bare = F.translate(bare, "‘’“”", "''''")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9'\s-]", " "), r"\s+", " "))


def raw_tokens(text: Column) -> Column:
    """What stands between blanks, without hyphens and quotes at its ends; all in one pass over the text."""
    return F.split(F.regexp_replace(normalize_text(text), "(?<![^ ])[-']+|[-']+(?![^ ])", ""), " ")


def is_token(raw: Column, min_length: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    found = (F.length(raw) >= min_length) & ~raw.rlike(r"^\d$")
    return found & ~raw.isin(*stop_words) if stop_words else found


def tokenize(text: Column, min_length: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens of a text in order, with repeats; a null text gives null. Where rows will do, explode raw_tokens and filter them."""
    return F.filter(raw_tokens(text), lambda t: is_token(t, min_length, stop_words))


def fnv1a64(text: Column) -> Column:
    """64-bit FNV-1a over the characters of a text, as a bit pattern in a long.

    The state is two 32-bit halves; the prime is 2**40 + 435, so that no product overflows. The text is
    computed once, not for each of its characters.
    """
    mask, prime = F.lit(0xFFFFFFFF), F.lit(435)
    start = F.struct(F.lit(3421674724).alias("hi"), F.lit(2216829733).alias("lo"))

    def hashed(text: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            y = acc["lo"].bitwiseXOR(F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
            carry = F.floor(y * prime / F.lit(4294967296)).cast("long")
            return F.struct((acc["hi"] * prime + carry + y * 256).bitwiseAND(mask).alias("hi"), (y * prime).bitwiseAND(mask).alias("lo"))

        places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"]))

    return F.get(F.transform(F.array(text), hashed), F.lit(0))


def hex64(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / 64


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def first_line(text: Column, most: int = 90) -> Column:
    """First line that isn't blank, cut with an ellipsis."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    line = F.trim(F.coalesce(F.get(lines, F.lit(0)), F.lit("")))
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line)


def title_from_keywords(keywords: Column, text: Column) -> Column:
    first = F.transform(F.slice(keywords, 1, 3), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000)))
    return F.when(F.size(keywords) > 0, F.array_join(first, " ")).otherwise(first_line(text, 60))


def slugify(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(normalize_text(text), "'", ""), r"[^a-z0-9\s-]", "")
    return F.substring(F.regexp_replace(F.trim(bare), r"\s+", "-"), 1, 64)


def detect_language(text: Column, markers: dict[str, tuple[str, ...]] = LANGUAGE_MARKERS) -> Column:
    """The language with more of its markers in the text; ties go to the first, `und` without any."""
    from .words import normalized  # it reads this module

    padded = F.concat(F.lit(" "), normalized(text), F.lit(" "))  # made once for all markers
    counts = {lang: sum((F.contains(padded, F.lit(m)).cast("int") for m in words), F.lit(0)) for lang, words in markers.items()}
    best = F.greatest(*counts.values())
    out = F.lit("und")
    for lang, n in reversed(list(counts.items())):
        out = F.when((n == best) & (best > 0), F.lit(lang)).otherwise(out)
    return out


def strip_html(text: Column) -> Column:
    """Paragraph and line breaks become newlines, tags vanish, the common character references are decoded."""
    out = F.regexp_replace(text, r"(?i)<p\b[^>]*>|<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for name, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&#x2F;", "/"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(letter))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def squeeze_tags(text: Column, most: int | None = 1500) -> Column:
    """Text without tags, in single blanks; whole if most is None."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))
    return bare if most is None else F.substring(bare, 1, most)


def normalize_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "")))


def primary_language(tag: Column) -> Column:
    return F.lower(F.get(F.split(tag, "[-_]"), F.lit(0)))


# Function words of six languages, the default of detect_source_language.
SOURCE_MARKERS = {
    "es": "que de la el los las un una para con es son está esta este pero porque muy también desde hasta como más fue han tiene puede donde cuando entre sobre sin hay todo todos su al del se por y o ya lo nos".split(),
    "en": "the and of is are was were to in for with that this from have has will not but you they we it as at on by or an be been their there what which when where who how because about into more most some such can could would should very also than then them these those".split(),
    "fr": "le les des une un et est pour avec que qui dans sur plus pas nous vous je il elle ce cette au aux du son sa ses mais ou où être sont été votre notre leur leurs ainsi donc comme tout tous bien fait de la".split(),
    "de": "der die das und ist nicht ein eine einen mit für sich den dem des auch auf aus bei nach werden wird sind von zu im zur zum dass wie aber noch nur kann muss über unter zwischen wenn als sein seine diese dieser dieses".split(),
    "pt": "que não nao uma um para com os as do da dos das em por mais como mas foi são sao está esta isso ele ela você voce nós nos também tambem já ja até ate muito quando onde seu sua seus suas ao aos todos".split(),
    "it": "il che di una un per con non sono è e anche più piu come ma questo questa gli le lo dei delle della nel nella si ha hanno molto quando dove suo sua loro essere stato dopo prima senza tra fra dal dalla la".split(),
}
#: (language, letters, weight): letters that hint at a language.
LETTER_HINTS = (("es", "[ñ¿¡]", 3), ("de", "ß", 3), ("pt", "[ãõ]", 3), ("fr", "œ", 3), ("fr", "ç", 1), ("pt", "ç", 1))


def detect_source_language(text: Column, markers: dict[str, list[str]] = SOURCE_MARKERS, hints: tuple[tuple[str, str, int], ...] = LETTER_HINTS, least_chars: int = 12, least_points: int = 2) -> Column:
    """The language with most points; null for short texts, few points, a tie, or a null text.

    A marker in the text gives one point to each language that has it, two if only one has it.
    """
    lower = F.lower(F.trim(text))
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^\p{L}\s'-]+", " "), r"\s+", " ")), " "))
    shared = [w for ws in markers.values() for w in ws]
    bound = lambda value, made: F.get(F.transform(F.array(value), made), F.lit(0))  # noqa: E731  value is computed once

    def points(seen: Column) -> Column:
        every = []
        for lang, ws in markers.items():
            total = F.lit(0)
            for weight in (1, 2):
                group = [w for w in dict.fromkeys(ws) if (shared.count(w) == 1) == (weight == 2)]
                if group:
                    total = total + weight * F.size(F.array_intersect(seen["words"], F.array(*map(F.lit, group))))
            for hinted, letters, weight in hints:
                if hinted == lang:
                    total = total + F.when(seen["lower"].rlike(letters), weight).otherwise(0)
            every.append(total)
        return F.array(*every)

    def winner(n: Column) -> Column:
        best = F.array_max(n)
        return F.when((best >= least_points) & (F.size(F.filter(n, lambda x: x == best)) == 1), F.get(F.array(*map(F.lit, markers)), F.array_position(n, best).cast("int") - 1))

    return F.when(F.length(F.trim(text)) >= least_chars, bound(bound(F.struct(words.alias("words"), lower.alias("lower")), points), winner))
