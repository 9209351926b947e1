"""What an edition's format, language, title and links say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _like(value: Column, pattern: str) -> Column:
    return F.regexp_like(F.lower(F.coalesce(value, F.lit(""))), F.lit(pattern))


def format_bucket(value: Column) -> Column:
    return (
        F.when(_like(value, "audio|sound recording|compact disc"), "audiobook")
        .when(_like(value, "paperback|softcover|soft cover"), "paperback")
        .when(_like(value, "hardback|hardcover|hard cover"), "hardcover")
        .otherwise(F.when(F.trim(value) != "", F.trim(value)))
    )


#: A year or range of years, what ends a calendar's title, and the three shapes of such titles.
YEAR_RANGE, CALENDAR_SUFFIX = r"\d{4}(?:[-–]\d{4})?", r"(?:\s*[:;(]|$)"
CALENDAR_TITLES = (
    r"\b(?:advent|wall|desk|engagement|pocket|perpetual|daily|page-a-day|day-to-day)[\s-]+calendars?\b",
    rf"\b{YEAR_RANGE}[\s-]+(?:wall[\s-]+|desk[\s-]+)?calendars?{CALENDAR_SUFFIX}",
    rf"\bcalendars?[\s-]+{YEAR_RANGE}{CALENDAR_SUFFIX}",
)
#: Kinds of products that are no plain book, in the order of the test; patterns on format and on title.
PRODUCTS = (
    ("audiobook", r"\b(?:audiobook|audio\s*cd|sound\s+recording|compact\s+disc|cassette|audio\s+cassette|mp3(?:\s*cd)?|spoken\s+word)\b", r"\b(?:audiobook|audio\s*cd|sound\s+recording|audio\s+cassette|spoken\s+word)\b"),
    ("ebook", r"\b(?:ebook|e-book|electronic|digital|kindle|epub|pdf|mobi|online\s+resource|nook)\b", r"\b(?:ebook|e-book|electronic\s+resource|kindle\s+edition)\b"),
    ("large_print", r"\b(?:large\s+print|giant\s+print|lp)\b", r"\b(?:large\s+print|giant\s+print)\b"),
    ("boxed_set", r"\b(?:boxed\s+set|box\s+set|slipcase|pack|bundle|boxset)\b", r"\b(?:boxed\s+set|box\s+set|boxset|\d+\s+books?\s+set|\d+\s+volumes?\s+set|collection\s+set)\b"),
    ("calendar", r"\bcalendar\b", "|".join(CALENDAR_TITLES)),
    ("journal", r"\b(?:journal|diary|blank\s+book|notebook|dayplanner|agenda)\b", r"\b(?:blank\s+journal|ruled\s+journal|lined\s+journal|day\s+planner|guided\s+journal)\b"),
    ("cards", r"\b(?:cards?|flashcards?|deck|tarot|playing\s+cards)\b", r"\b(?:card\s+deck|tarot\s+deck|flash\s*cards?|playing\s+cards)\b"),
    ("non_book", r"\b(?:puzzle|game|board\s+game|toy|doll|kit|poster|stationery|merchandise|accessory)\b", r"\b(?:jigsaw\s+puzzle|board\s+game|coloring\s+poster|plush\s+toy)\b"),
)


def product_kind(format: Column, title: Column, subtitle: Column) -> Column:
    """The first kind of other product that format or title names; null for a book."""
    text, kind = F.concat_ws(" ", title, subtitle), F.when(F.lit(False), F.lit(None).cast("string"))
    novel = _like(text, r"\badvent[\s-]+calendars?\b") & _like(text, r"\([^)]*\bnovel\b[^)]*\)")
    for name, in_format, in_title in PRODUCTS:
        by_title = _like(text, in_title) & ~novel if name == "calendar" else _like(text, in_title)
        kind = kind.when(_like(format, in_format) | by_title, name)
    return kind


#: Variants of a work that a plain source title doesn't ask for.
VARIANTS = (
    ("study_guide", r"\bstudy\s+guides?\b"),
    ("summary", r"\b(?:summary|summaries)\b"),
    ("companion", r"\bcompanions?\b"),
    ("graphic_adaptation", r"\bgraphic\s+(?:adaptations?|novels?)\b|\bcomic\s+adaptations?\b"),
    ("collection", r"\b(?:omnibus|complete\s+collection|collected\s+works|box(?:ed)?\s+set)\b"),
)


def other_variant(source_key: Column, candidate_key: Column) -> Column:
    """The first variant that the candidate's folded title names and the source's doesn't."""
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in VARIANTS:
        kind = kind.when(_like(candidate_key, pattern) & ~_like(source_key, pattern), name)
    return kind


def trade_format(formats: Column) -> Column:
    return _like(formats, r"\b(?:trade\s+paperback|paperback|hardcover|hardback)\b")


def audio_only(formats: Column, title: Column) -> Column:
    return _like(F.concat_ws(" ", formats, title), r"\b(?:audio(?:book|\s+book|\s+cd)?|audible|mp3\s+cd|cassette)\b") & ~trade_format(formats)


def library_binding(formats: Column) -> Column:
    return _like(formats, r"\b(?:library|school)\s+binding\b|\bturtleback\b")


def large_print(formats: Column) -> Column:
    return _like(formats, r"\blarge\s+print\b")


def language_code(value: Column) -> Column:
    """Last part of a language key, English as en."""
    code = F.lower(F.element_at(F.filter(F.split(F.trim(value), "/"), lambda x: x != ""), -1))
    return F.when(code.isin("eng", "en"), "en").otherwise(code)


def edition_language(languages: Column) -> Column:
    codes = F.filter(F.transform(languages, language_code), lambda x: x.isNotNull())
    return F.when(F.array_contains(codes, "en"), "en").otherwise(F.get(codes, F.lit(0)))


def is_english(value: Column) -> Column:
    language = F.replace(F.lower(value), F.lit("_"), F.lit("-"))
    return language.isin("en", "eng", "english") | F.startswith(language, F.lit("en-"))


def names_english(languages: Column) -> Column:
    """Whether a list of language keys has English itself."""
    return F.coalesce(F.exists(languages, lambda x: F.regexp_replace(F.lower(F.trim(x)), "^/languages/", "") == "eng"), F.lit(False))


def feed_language_ok(code: Column, description: Column) -> Column:
    """English by code, else by description; accepted if neither is given."""
    english = lambda x: F.upper(x).isin("E", "EN", "ENG") | F.startswith(F.lower(x), F.lit("english"))
    code, description = F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(description), F.lit(""))
    return F.when(code.isNotNull(), english(code)).when(description.isNotNull(), english(description)).otherwise(True)


#: What excludes a publisher's format, by its description.
EXCLUDED_FORMATS = "e-book|ebook|electronic|digital|audio|cd|large print|box|set|pack|collection|calendar|card|deck|diary|journal|puzzle|toy|game"


def format_rank(code: Column, description: Column) -> Column:
    """1 hardcover, 2 trade paperback, 3 paperback, 4 other print, -1 excluded."""
    code, text = F.upper(F.coalesce(code, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    out = code.isin("EB", "EC", "AB", "CD", "AD", "AU") | F.regexp_like(text, F.lit(EXCLUDED_FORMATS))
    return (
        F.when(out, -1)
        .when((code == "HC") | F.contains(text, F.lit("hardcover")), 1)
        .when((code == "TR") | F.contains(text, F.lit("trade paperback")), 2)
        .when(code.isin("PB", "MM") | F.regexp_like(text, F.lit("paperback|mass market")), 3)
        .otherwise(4)
    )


def cover_url(cover_ids: Column, base: str) -> Column:
    cover = F.get(F.filter(cover_ids, lambda x: x > 0), F.lit(0))
    return F.when(cover.isNotNull(), F.concat(F.lit(base), cover.cast("string")))


def https_host(url: Column) -> Column:
    """Host of a valid https address, else null."""
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", F.lower(F.try_parse_url(url, F.lit("HOST"))))


#: Controlled genres with the subjects that stand for them.
GENRES = {
    "Fantasy": ("fantasy", "fantasy fiction"),
    "Science Fiction": ("science fiction",),
    "Mystery": ("mystery", "detective and mystery stories", "mystery fiction"),
    "Romance": ("romance", "love stories", "romance fiction"),
    "History": ("history", "world history"),
    "Biography": ("biography", "autobiography", "memoir", "autobiographies"),
    "Science": ("science", "popular science", "physics"),
    "Philosophy": ("philosophy",),
    "Poetry": ("poetry",),
    "Children": ("children", "children's fiction", "juvenile fiction"),
    "Fiction": ("fiction", "literary fiction"),
}


def subject_genres(subjects: Column) -> Column:
    """Controlled genres, in their fixed order, of which a subject is an alias."""
    low = F.transform(subjects, lambda s: F.lower(F.trim(s)))
    picked = [F.when(F.arrays_overlap(low, F.array(*map(F.lit, names))), genre) for genre, names in GENRES.items()]
    return F.filter(F.array(*picked), lambda x: x.isNotNull())


#: What a publisher's category text must name, with the genres that it then gives. Of rules
#: with the same group only the first that fits counts; a rule with a bar doesn't count beside that genre.
CATEGORY_RULES = (
    ("sf", r"\bspace\s*opera\b", ("space-opera", "science-fiction"), None),
    ("sf", r"\bdystop(?:ian|ia)\b|\bpost[- ]apocalyptic\b", ("dystopian", "science-fiction"), None),
    ("sf", r"\bscience\s*fiction\b|\bsci[- ]fi\b", ("science-fiction",), None),
    ("fantasy", r"\bepic\s*fantasy\b|\bhigh\s*fantasy\b", ("epic-fantasy", "fantasy"), None),
    ("fantasy", r"\burban\s*fantasy\b|\bparanormal\b", ("urban-fantasy", "fantasy"), None),
    ("fantasy", r"\bmagical\s*realism\b", ("magical-realism", "fantasy"), None),
    ("fantasy", r"\bfantasy\b", ("fantasy",), None),
    ("historical", r"\bhistorical\s*fiction\b|\bhistorical\b.*\bfiction\b", ("historical-fiction",), None),
    ("literary", r"\bliterary\s*fiction\b|\bliterary\b.*\bfiction\b", ("literary-fiction",), None),
    ("contemporary", r"\bcontemporary\b", ("contemporary",), None),
    ("romance", r"\bromance\b|\bromantic\b", ("romance",), None),
    ("mystery", r"\bmystery\b|\bdetective\b|\bwhodunit\b", ("mystery",), None),
    ("thriller", r"\bthriller\b|\bsuspense\b|\bpsychological\s*thriller\b", ("thriller",), None),
    ("crime", r"\btrue\s*crime\b", ("true-crime",), None),
    ("crime", r"\bcrime\b|\bnoir\b", ("crime",), None),
    ("horror", r"\bhorror\b|\bghost\b|\bsupernatural\s*horror\b", ("horror",), None),
    ("classics", r"\bclassics?\b|\bclassical\s*literature\b", ("classics",), None),
    ("adventure", r"\baction\s*&\s*adventure\b|\badventure\b", ("adventure",), None),
    ("young", r"\byoung\s*adult\b|\bya\b|\bteen\b", ("young-adult",), None),
    ("children", r"\bchildren\b|\bjuvenile\b|\bmiddle\s*grade\b", ("children",), None),
    ("memoir", r"\bmemoir\b|\bautobiograph\w*\b", ("memoir",), None),
    ("biography", r"\bbiograph\w*\b", ("biography",), None),
    ("history", r"\bhistory\b|\bhistorical\b", ("history",), "historical-fiction"),
    ("science", r"\bscience\b|\bnature\b|\bastronomy\b|\bphysics\b|\bbiology\b", ("science",), "science-fiction"),
    ("psychology", r"\bpsychology\b|\bcognitive\b|\bmental\s*health\b", ("psychology",), None),
    ("philosophy", r"\bphilosophy\b|\bethics\b", ("philosophy",), None),
    ("politics", r"\bpolitics\b|\bpolitical\s*science\b|\bgovernment\b", ("politics",), None),
    ("economics", r"\beconomics\b|\beconomy\b", ("economics",), None),
    ("business", r"\bbusiness\b|\bmanagement\b|\bleadership\b", ("business",), None),
    ("self", r"\bself[- ]help\b|\bpersonal\s*growth\b", ("self-help",), None),
    ("religion", r"\breligion\b|\bspirituality\b|\btheology\b", ("religion-spirituality",), None),
    ("travel", r"\btravel\b|\bexploration\b", ("travel",), None),
    ("humor", r"\bhumor\b|\bcomedy\b|\bsatire\b", ("humor",), None),
    ("essays", r"\bessays\b|\bliterary\s*collections?\b", ("essays",), None),
    ("poetry", r"\bpoetry\b|\bpoems?\b", ("poetry",), None),
    ("drama", r"\bdrama\b|\bplays?\b|\btheater\b", ("drama",), None),
)


def category_text(description: Column, uri: Column, menu: Column) -> Column:
    """A publisher's category as one lower-case text of its description, address and menu entry, without empty ones."""
    return F.lower(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (description, uri, menu))))


def category_genres(categories: Column, most: int = 3) -> Column:
    """Up to three genres of a list of category texts, in the order in which rules name them."""

    def one(text: Column) -> Column:
        text, fits, lists = F.lower(text), {}, []
        none = F.array().cast("array<string>")
        for group, pattern, genres, bar in CATEGORY_RULES:
            own = F.regexp_like(text, F.lit(pattern))
            earlier = fits.setdefault(group, [])
            this = own
            for other in earlier:
                this = this & ~other
            earlier.append(own)
            if bar:
                pattern_of_bar = next(p for _, p, g, _ in CATEGORY_RULES if bar in g) if bar != "science-fiction" else "|".join(p for _, p, g, _ in CATEGORY_RULES if bar in g)
                this = this & ~F.regexp_like(text, F.lit(pattern_of_bar))
            lists.append(F.when(this, F.array(*map(F.lit, genres))).otherwise(none))
        found = F.concat(*lists)
        return F.when((F.size(found) == 0) & F.regexp_like(text, F.lit(r"\bfiction\b")), F.array(F.lit("fiction"))).otherwise(found)

    return F.slice(F.array_distinct(F.flatten(F.transform(F.filter(categories, lambda x: x.isNotNull()), one))), 1, most)
