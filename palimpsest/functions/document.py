"""Rules for the text of digitised documents as Column expressions: normal forms and
error rates, trust in text layers, kinds of lines, Markdown and YAML forms, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import nfc, token_distance

# White space and line ends; limits of the text-layer rules; box-drawing characters; kinds of paragraphs.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
LINE_ENDS = r"\r\n|[\n-\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
LEAST_CHARS, REPLACED_LIMIT, CONTROL_LIMIT, GLYPH_LIMIT, DENSITY_LIMIT = 10, 0.01, 0.02, 0.03, 15
BOX_DRAWING = "┌┐└┘├┤┬┴┼│─═╔╗╚╝║"
HEADING1, HEADING3 = rf"^\d+(\.\d+)*[.)]{WS}+{NOT_WS}", rf"^[A-Z]\d+{WS}*[-–—.]{WS}*[\p{{L}}\p{{N}}_]"
LABEL = rf"(?i)^(page{WS}+\d|fax{WS}+(no|number)\b)"
KEY_VALUE, CODE = rf"^[^:]{{3,40}}:{WS}+[^\n]+\n?\z", rf"^[A-Z]\d*(\.\d+)*{WS}*[-–—.]"
INLINE_MARKS, START_MARKS = r"([\\`*_\[\]<>|])", r"^([#\-+>]|\d+\.(?=\s|$))"


def stripped(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def glyph_ratio(text: Column) -> Column:
    """Lost glyphs for each character of the stripped text: U+FFFD, the white square, and
    three for each run of three question marks."""
    return (count_of(text, "[�□]") + 3 * count_of(text, r"\?\?\?")) / F.greatest(F.length(stripped(text)), F.lit(1))


def layer_reason(text: Column, area: Column) -> Column:
    """Why a native text layer isn't trusted, or null: the first rule that fails. area: the
    page's, in square points; 0 or null where unknown."""
    s = stripped(text)
    n = F.length(s)
    return (
        F.when(n == 0, "empty")
        .when(n < LEAST_CHARS, "too_few_chars")
        .when(count_of(s, "�") / n > REPLACED_LIMIT, "fffd_ratio")
        .when(count_of(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]") / n > CONTROL_LIMIT, "nonprint_ratio")
        .when(glyph_ratio(s) > GLYPH_LIMIT, "suspicious_glyph_loss")
        .when((area > 0) & (n / F.greatest(area / 1000.0, F.lit(1.0)) > DENSITY_LIMIT), "implausible_text_density")
    )


def layer_status(reason: Column) -> Column:
    return F.when(reason.isNull(), "trusted").when(reason == "empty", "absent").otherwise("rejected")


def searchable_reason(text: Column) -> Column:
    """Why extracted text isn't searchable, or null."""
    return F.when(F.length(stripped(text)) == 0, "empty extracted text").when(glyph_ratio(text) > GLYPH_LIMIT, "suspicious glyph loss")


def preformatted(text: Column) -> Column:
    """Three box-drawing characters, or all three marks of code."""
    return (count_of(text, f"[{BOX_DRAWING}]") >= 3) | (text.contains("{") & text.contains(";") & text.contains("}"))


def heading_kind(text: Column) -> Column:
    """heading1 for numbered sections, heading2 for capitals, heading3 for a code and a
    separator, else null."""
    s = stripped(text)
    n, latin = F.length(s), F.regexp_replace(s, "[^a-zA-ZÀ-ÿ]", "")
    capitals = latin.rlike("[A-ZÀ-ÖØ-Þ]") & ~latin.rlike("[a-zß-öø-ÿ]") & (F.length(latin) >= 5)
    return (
        F.when((n < 3) | (n > 120) | (count_of(s, r"\p{L}") < 2), F.lit(None))
        .when(s.rlike(HEADING1) & (n < 80), "heading1")
        .when(capitals & (n < 60) & (count_of(s, f"{NOT_WS}+") <= 5), "heading2")
        .when(s.rlike(HEADING3) & (n < 60), "heading3")
    )


def plausible_heading(text: Column) -> Column:
    """Not a page or fax label, a field with its value, mostly digits, or one word without vowels."""
    s = stripped(text)
    letters, digits = count_of(s, r"\p{L}"), count_of(s, r"\p{Nd}")
    bad = (
        (F.length(s) == 0)
        | s.rlike(LABEL)
        | (s.contains(":") & ~s.endswith(":"))
        | ((digits > 0) & (digits / F.greatest(letters + digits, F.lit(1)) >= 0.1))
        | ((count_of(s, f"{NOT_WS}+") == 1) & (letters > 0) & ~s.rlike("(?i)[AEIOUY]"))
    )
    return ~bad


def key_value(text: Column) -> Column:
    return text.rlike(KEY_VALUE) & (F.length(text) < 120)


def paragraph_kind(text: Column, indented: Column) -> Column:
    """preformatted, heading1 to heading3, kv, paragraph_indent or paragraph."""
    return (
        F.when(preformatted(text), "preformatted")
        .when(heading_kind(text).isNotNull() & plausible_heading(text), heading_kind(text))
        .when(key_value(text) & ~text.rlike(CODE), "kv")
        .when(indented, "paragraph_indent")
        .otherwise("paragraph")
    )


def structural(text: Column) -> Column:
    """Numbered sections, list items, lines in capitals, and coded sections whose label is in capitals."""
    s = stripped(text)
    upper = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"[\p{Ll}\p{Lt}]")
    coded = rf"^[A-Z]{{1,3}}\d*{WS}*[-–\.]{WS}+"
    label = F.substring_index(s, ":", 1)
    letters = count_of(label, r"\p{L}")
    labelled = (letters > 0) & (count_of(label, r"\p{Lu}") / letters > 0.7)
    rest = F.regexp_replace(s, coded, "")
    section = s.rlike(coded) & F.when(F.instr(s, ":") > 1, labelled).otherwise(~s.contains(":") & upper(rest))
    return (F.length(s) > 0) & (s.rlike(rf"^\d+(\.\d+)*\.?{WS}+[A-ZÀ-Ú]") | s.rlike(f"^[-•●○■□▪►]{WS}") | (upper(s) & (F.length(s) > 4)) | section)


def joined_line(text: Column, following: Column) -> Column:
    """A line and its continuation as one, or null: a word parted by a hyphen, or a
    sentence that goes on in lower case."""
    end = F.regexp_replace(text, f"{WS}+$", "")
    lower = following.rlike(r"^\p{Ll}")
    return F.when(end.rlike(r"\p{L}-$") & lower, F.concat(F.regexp_replace(end, "-$", ""), following)).when(end.rlike(r"[\p{L},]$") & lower, F.concat(end, F.lit(" "), following))


def proportional_spaces(gap: Column, char_width: Column) -> Column:
    """Spaces for a gap, 1 to 8; halves go to the even number."""
    return F.when(char_width > 0, F.least(F.greatest(F.rint(gap / char_width), F.lit(1.0)), F.lit(8.0)).cast("int")).otherwise(1)


def markdown_inline(text: Column) -> Column:
    return F.regexp_replace(text, INLINE_MARKS, r"\\$1")


def markdown_text(text: Column) -> Column:
    """Marks escaped anywhere, and block marks at the start of the string."""
    return F.regexp_replace(markdown_inline(text), START_MARKS, r"\\$1")


def markdown_field(text: Column) -> Column:
    """A key before the first colon in bold, and its value."""
    s = stripped(text)
    key, value = F.substring_index(s, ":", 1), F.regexp_replace(s, "(?s)^[^:]*:", "")
    bold = F.concat(F.lit("**"), markdown_text(stripped(key)), F.lit(":** "), markdown_text(stripped(value)))
    return F.when(s.contains(":"), bold).otherwise(markdown_text(s))


def yaml_scalar(text: Column) -> Column:
    """Without control characters; backslashes and quotes escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f]", ""), r'([\\"])', r"\\$1")


def file_size(n: Column) -> Column:
    """Bytes in 1024-based units: two decimals below 10, one below 100, none above."""
    units = ["B", "KB", "MB", "GB", "TB"]

    def told(power: int) -> Column:
        x = n.cast("double") / 1024**power
        whole = F.floor(x).cast("long").cast("string")
        number = F.when(x >= 100, whole).when(x >= 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.2f", F.bround(x, 2))) if power else whole
        return F.concat(number, F.lit(f" {units[power]}"))

    out = F.when(F.coalesce(n, F.lit(0)) <= 0, "0 B")
    for power in range(4):
        out = out.when(n < 1024 ** (power + 1), told(power))
    return out.otherwise(told(4))


def normal_form(text: Column) -> Column:
    """The form in which texts are compared: NFC, no-break spaces as spaces, one space for
    a run of blanks, one empty line at most, nothing at the ends. Null is empty."""
    x = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), " ", " ")
    return stripped(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def char_error(got: Column, wanted: Column) -> Column:
    """Edits for each expected character, of normal forms; may exceed 1."""
    return F.levenshtein(got, wanted) / F.greatest(F.length(wanted), F.lit(1))


def likeness(got: Column, wanted: Column) -> Column:
    return 1.0 - F.levenshtein(got, wanted) / F.greatest(F.length(got), F.length(wanted), F.lit(1))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, f"{WS}+"), lambda x: F.length(x) > 0)


def word_error(got: Column, wanted: Column) -> Column:
    """Edits of words for each expected word, of normal forms."""
    return token_distance(tokens(got), tokens(wanted)) / F.greatest(F.size(tokens(wanted)), F.lit(1))


def sorted_form(normal: Column) -> Column:
    """A normal form's lines in order, in normal form: errors that ignore the order of lines."""
    return normal_form(F.array_join(F.array_sort(F.split(normal, LINE_ENDS)), "\n"))


def fill_threshold(ratios: Column) -> Column:
    """0.88 of the ratio at nine tenths of those over 0.1, 0.55 at least; 0.75 without any."""
    some = F.array_sort(F.filter(ratios, lambda r: r > 0.1))
    at = F.least(F.floor(F.size(some) * 0.9), F.size(some) - 1).cast("int")
    return F.when(F.size(some) == 0, F.lit(0.75)).otherwise(F.greatest(F.get(some, at) * 0.88, F.lit(0.55)))


def retry_reason(n_boxes: Column, mean_score: Column, has_image: Column) -> Column:
    """Why a page is recognised again, or null."""
    return F.when(~has_image, F.lit(None)).when(F.coalesce(n_boxes, F.lit(0)) == 0, "no_boxes").when(F.coalesce(mean_score, F.lit(0.0)) < 0.75, "low_confidence")


def better_reading(text: Column, score: Column, turned: Column, turned_score: Column) -> Column:
    """text, score and replaced: the turned reading if it isn't blank and gains 0.05."""
    wins = (F.length(stripped(turned)) > 0) & (turned_score >= score + 0.05)
    return F.struct(F.when(wins, turned).otherwise(text).alias("text"), F.when(wins, turned_score).otherwise(score).alias("score"), wins.alias("replaced"))
