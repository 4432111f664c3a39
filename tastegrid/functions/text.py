"""Text expressions: cleaning, labelled rows, token budgets, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tastegrid.constants import TOKEN_BUDGET

# Fixed patterns.
HTML_TAG = r"<[^>]+>"
FIRST_DIGITS = r"(\d+)"
REVIEW_DATE = "MM d, yyyy"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def strip_tags_everywhere(df: DataFrame) -> DataFrame:
    """Strip HTML tags from every string column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: strip_tags(F.col(n)) for n in names})


def first_number(text: Column) -> Column:
    """First run of digits as a double (a rank such as '1,234 in Beauty' gives 1)."""
    return F.nullif(F.regexp_extract(text, FIRST_DIGITS, 1), F.lit("")).try_cast("double")


def price_number(text: Column) -> Column:
    """'$12.5' to 12.5; ranges and separators give null."""
    return F.replace(text, F.lit("$"), F.lit("")).try_cast("double")


def review_date(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(REVIEW_DATE)).cast("date")


def nested_cell(text: Column, ddl: str) -> Column:
    """Pseudo-JSON cell (single quotes allowed) as a nested value; null when unparseable."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), ddl)


def shown(col: Column) -> Column:
    """A value as it appears in context text; a missing value is printed as 'nan'."""
    return F.coalesce(col.cast("string"), F.lit("nan"))


def labelled_text(columns: list[str], sep: str = ". ") -> Column:
    """'col: value' parts joined by ``sep``; null cells are kept, printed as 'nan'."""
    return F.concat_ws(sep, *[F.concat(F.lit(f"{c}: "), shown(F.col(c))) for c in columns])


def tokens(text: Column) -> Column:
    """Whitespace tokens without empties."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def within_budget(text: Column, budget: int = TOKEN_BUDGET) -> Column:
    """The text itself when it fits the token budget, else its first ``budget`` tokens."""
    words = tokens(text)
    return F.when(
        F.size(words) > budget, F.array_join(F.slice(words, 1, budget), " ")
    ).otherwise(text)


def ngrams(words: Column, n: int) -> Column:
    """All n-grams of a token array as space-joined strings."""
    count = F.size(words) - (n - 1)
    return F.when(
        count >= 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda i: F.array_join(F.slice(words, i, n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))
