"""Text functions: folding, names, HTML, quotes, packed values."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits, affixes of group names, column separators.
FULL_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
GENDERS = ("男子", "女子", "男女")
SUFFIXES = ("同好会", "愛好会", "クラブ", "部", "班")
DOT = "・"


def fold_digits(x: Column) -> Column:
    return F.translate(x, FULL_DIGITS, DIGITS)


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Unicode NFKC, which no built-in function does."""
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    """All HTML entities."""
    return x.map(lambda v: None if v is None else html.unescape(v))


#: An entity with the semicolon that ends it.
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(T.StringType())
def unescape_closed(x: pd.Series) -> pd.Series:
    """All HTML entities that a semicolon ends; what is cut off before it stays as it is."""
    known = lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]
    return x.map(lambda v: None if v is None else ENTITY.sub(known, v))


def bare(x: Column) -> Column:
    """Without blanks (the ideographic one too), dots and brackets."""
    return F.regexp_replace(x, r"[\s　・()（）]", "")


def base_name(x: Column) -> Column:
    """A group's name without gender prefix and organisation suffix."""
    return F.regexp_replace(F.regexp_replace(x, "^(" + "|".join(GENDERS) + ")", ""), "(" + "|".join(SUFFIXES) + ")$", "")


def organisation(x: Column) -> Column:
    """The first suffix, in order, that the name ends with."""
    return F.coalesce(*(F.when(x.endswith(s), s) for s in SUFFIXES), F.lit(""))


def sorted_key(x: Column) -> Column:
    """The characters of a name in order: equal for names that are anagrams."""
    return F.array_join(F.array_sort(F.filter(F.split(x, ""), lambda c: c != "")), "")


def school_key(x: Column) -> Column:
    return F.regexp_replace(x, "^東京都立|高等学校|高校", "")


def pieces(x: Column) -> Column:
    """A joined item in parts: at dots if every part looks like a group, at blanks if long and of three parts."""
    parts = F.filter(F.split(x, DOT), lambda p: p != "")
    words = F.filter(F.split(x, r"[\s　]+"), lambda p: p != "")
    return F.when(F.forall(parts, lambda p: p.rlike("(" + "|".join(SUFFIXES) + ")$")), parts).when((F.length(x) >= 10) & (F.size(words) >= 3), words).otherwise(F.array(x))


def teams(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"[・､,，／/]|[\s　]{2,}"), lambda p: F.regexp_replace(p, r"[\s　]", "")), lambda p: p != "")


def strip_noise(page: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(page, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")


def html_text(page: Column) -> Column:
    """Text of HTML: a blank between tags that adjoin, so that a tag inside a word doesn't part it; blanks collapsed."""
    broken = F.regexp_replace(strip_noise(page), r"(?i)<br\s*/?>", " ")
    plain = F.regexp_replace(F.regexp_replace(broken, r">\s*<", "> <"), r"(?s)<[^>]*>", "")
    decoded = F.replace(F.replace(plain, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(decoded, r"[\s　]+", " "))


def html_lines(page: Column, closed: bool = False) -> Column:
    """Non-blank lines of HTML: block tags end a line, other tags are blanks, the head is left out, entities decoded (``closed``: only those that a semicolon ends)."""
    body = F.regexp_replace(strip_noise(page), r"(?is)<head\b.*?</head\s*>", " ")
    broken = F.regexp_replace(body, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])\s*>", "\n")
    decoded = unescape_closed if closed else unescape
    lines = F.split(decoded(F.regexp_replace(broken, r"(?s)<[^>]*>", " ")), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\s\x{A0}　]+", " "))), lambda x: x != "")


def section(x: Column, start: str, stop: str, limit: int) -> Column:
    """Text from a marker to the next stop marker, of at most ``limit`` characters."""
    at = F.instr(x, start)
    rest = F.when(at > 0, F.substring(x, at, F.lit(limit)))
    end = F.instr(rest, stop)
    return F.when(end > 1, F.substring(rest, F.lit(1), end - 1)).otherwise(rest)


def lines_between(lines: Column, starts: tuple[str, ...], stops: tuple[str, ...], most: int, keep: str | None = None) -> Column:
    """Of an array of lines those from the first with a word of ``starts`` (else from the first line) to before the next with one of ``stops``, ``most`` at most; of these the ones that match ``keep``."""

    def has(x: Column, words: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, (x.contains(w) for w in words), F.lit(False))

    def first(x: Column, words: tuple[str, ...]) -> Column:
        return F.array_position(F.transform(x, lambda v: has(v, words)), True)

    rest = F.slice(lines, F.greatest(first(lines, starts).cast("int"), F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
    end = first(rest, stops).cast("int")
    inner = F.slice(rest, F.lit(1), F.least(F.when(end > 0, end - 1).otherwise(F.size(rest)), F.lit(most)))
    return inner if keep is None else F.filter(inner, lambda v: v.rlike(keep))


def quote(x: Column) -> Column:
    """The first sentence, if it has 8 to 160 characters."""
    first = F.trim(F.split(x, "[。！.!]").getItem(0))
    return F.when(F.length(first).between(8, 160), first)


def label(sport: Column, event: Column, longest: int = 16) -> Column:
    """Sport with its event, if that adds anything and both fit; else the one that there is."""
    sport, event = F.trim(F.coalesce(sport, F.lit(""))), F.trim(F.coalesce(event, F.lit("")))
    adds = (sport != "") & (event != "") & (event != "団体") & ~F.contains(sport, event)
    return F.when(adds & (F.length(F.concat(sport, event)) <= longest), F.concat(sport, event)).when(sport != "", sport).otherwise(event)


def packed(x: Column) -> Column:
    """``k:v|k:v`` as an array of structs of key and integer value; other parts are dropped."""
    parts = F.transform(F.split(x, r"\|"), lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.split_part(p, F.lit(":"), F.lit(2))).try_cast("int").alias("v")))
    return F.filter(parts, lambda p: (p["k"] != "") & p["v"].isNotNull())


def json_inside(x: Column) -> Column:
    """From the first brace to the last, without thoughts and code fences."""
    plain = F.regexp_replace(F.regexp_replace(x, r"(?is)<think>.*?(</think>|\z)", ""), "```(json)?", "")
    return F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))


def token(x: Column) -> Column:
    """The JSON text of a base64url token."""
    plain = F.translate(x, "-_", "+/")
    return F.decode(F.try_to_binary(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")), "utf-8")


# Kana in Hepburn romanisation, syllables of two characters first.
DIGRAPHS = {
    "キャ": "kya", "キュ": "kyu", "キョ": "kyo", "シャ": "sha", "シュ": "shu", "ショ": "sho", "チャ": "cha", "チュ": "chu", "チョ": "cho", "ニャ": "nya", "ニュ": "nyu", "ニョ": "nyo",
    "ヒャ": "hya", "ヒュ": "hyu", "ヒョ": "hyo", "ミャ": "mya", "ミュ": "myu", "ミョ": "myo", "リャ": "rya", "リュ": "ryu", "リョ": "ryo", "ギャ": "gya", "ギュ": "gyu", "ギョ": "gyo",
    "ジャ": "ja", "ジュ": "ju", "ジョ": "jo", "ビャ": "bya", "ビュ": "byu", "ビョ": "byo", "ピャ": "pya", "ピュ": "pyu", "ピョ": "pyo",
}
KANA = {
    "ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o", "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko", "サ": "sa", "シ": "shi", "ス": "su", "セ": "se", "ソ": "so",
    "タ": "ta", "チ": "chi", "ツ": "tsu", "テ": "te", "ト": "to", "ナ": "na", "ニ": "ni", "ヌ": "nu", "ネ": "ne", "ノ": "no", "ハ": "ha", "ヒ": "hi", "フ": "fu", "ヘ": "he", "ホ": "ho",
    "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ラ": "ra", "リ": "ri", "ル": "ru", "レ": "re", "ロ": "ro", "ワ": "wa", "ヲ": "o", "ン": "n",
    "ガ": "ga", "ギ": "gi", "グ": "gu", "ゲ": "ge", "ゴ": "go", "ザ": "za", "ジ": "ji", "ズ": "zu", "ゼ": "ze", "ゾ": "zo", "ダ": "da", "ヂ": "ji", "ヅ": "zu", "デ": "de", "ド": "do",
    "バ": "ba", "ビ": "bi", "ブ": "bu", "ベ": "be", "ボ": "bo", "パ": "pa", "ピ": "pi", "プ": "pu", "ペ": "pe", "ポ": "po", "ァ": "a", "ィ": "i", "ゥ": "u", "ェ": "e", "ォ": "o",
}


def romaji(kana: Column) -> Column:
    """Katakana as a Hepburn slug: a small tsu doubles the next letter, ou and uu collapse; nothing else is kept."""
    out = F.regexp_replace(kana, "[a-z]", "-")
    for table in (DIGRAPHS, KANA):
        for k, v in table.items():
            out = F.replace(out, F.lit(k), F.lit(v))
    plain = F.regexp_replace(F.regexp_replace(out, "ッ([a-z])", "$1$1"), "[^a-z]", "")
    return F.replace(F.replace(plain, F.lit("ou"), F.lit("o")), F.lit("uu"), F.lit("u"))


# Suffixes that go, up to twice; what is no club: words anywhere in a name, and whole names.
CLUB_SUFFIX = "(部|班|同好会|愛好会|クラブ|会)$"
NOT_CLUB = r"委員会|生徒会|部活動一覧|部活動について|活動方針|年間行事|お知らせ|新着情報|一覧へ|詳しく|サイトマップ|問い合わせ|募集要項|学校説明会|ダウンロード|活動日|練習日|活動場所|大会|優勝|入賞|予選|報告|参加|開催|結果|により|に応じて|不定期|あり$|なし$|[：:！!※]|^\d+$|^令和|^平成|^[^\p{L}\p{N}_]+$"
NOT_CLUB_NAMES = ("ホーム", "トップ", "ページ", "このページの先頭へ", "アクセス", "PDF", "pdf", "詳細", "一覧", "こちら", "次へ", "前へ", "メニュー", "検索", "部活動")


def club(x: Column) -> Column:
    """A club's name in one spelling: compatible characters, no blanks, brackets or suffixes; a gender in brackets leads."""
    plain = nfkc(x)
    inner = F.transform(F.regexp_extract_all(plain, F.lit(r"\(([^)]*)\)"), 1), lambda b: F.regexp_replace(b, r"\s", ""))
    said = F.filter(F.transform(inner, lambda b: F.when(b.isin("男子", "男"), "男子").when(b.isin("女子", "女"), "女子")), lambda g: g.isNotNull())
    gender = F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(""))
    bare_name = F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", ""), r"[\s　・]", "")
    short = F.regexp_replace(F.regexp_replace(bare_name, CLUB_SUFFIX, ""), CLUB_SUFFIX, "")
    return F.when((gender != "") & ~short.startswith("男子") & ~short.startswith("女子"), F.concat(gender, short)).otherwise(short)


def is_club(x: Column) -> Column:
    """Whether a listed item can be a club, and no heading, note or link."""
    return ~x.rlike(NOT_CLUB) & ~x.isin(*NOT_CLUB_NAMES)


def extension(url: Column, content_type: Column) -> Column:
    """The file extension that a content type or an address tells."""
    kind, low = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    table = kind.contains("excel") | kind.contains("spreadsheet") | low.endswith(".xlsx") | low.endswith(".xls")
    named = F.when(kind.contains("pdf") | low.endswith(".pdf"), ".pdf").when(kind.contains("csv") | low.endswith(".csv"), ".csv")
    return named.when(table, ".xlsx").when(kind.contains("json"), ".json").otherwise(".html")


def resolved(base: Column, href: Column) -> Column:
    """An address given relative to another, whole: parent steps are taken, query and fragment go."""
    origin = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    path = F.regexp_replace(F.substring(base, F.length(origin) + 1, F.length(base)), "[?#].*$", "")
    bare_href = F.regexp_replace(href, "[?#].*$", "")
    joined = F.when(bare_href == "", path).when(bare_href.startswith("/"), bare_href).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), bare_href))
    steps = F.split(F.regexp_replace(joined, "/[.]{1,2}$", "$0/"), "/")
    walked = F.aggregate(steps, F.expr("cast(array() as array<string>)"), lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x))))
    return F.when(bare_href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare_href).when(bare_href.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), bare_href)).otherwise(F.concat(origin, F.array_join(walked, "/")))
