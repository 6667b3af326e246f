"""Projections, type gates and contract checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from evenkeel.functions.scalars import kind_of, missing, to_number

# Column names that identify a person or an account, after lower-casing and removal of
# everything but digits, Latin letters and Hangul syllables.
EXACT_IDENTIFIERS = [
    "id", "userid", "useridentifier", "customerid", "clientid", "memberid",
    "accountid", "loanid", "applicationid", "transactionid", "recordid",
    "name", "fullname", "firstname", "lastname", "middlename", "username",
    "phone", "phonenumber", "mobile", "mobilenumber", "telephone", "tel",
    "address", "homeaddress", "streetaddress", "mailingaddress",
    "email", "emailaddress",
    "ssn", "socialsecuritynumber", "residentregistrationnumber", "rrn",
    "passport", "passportnumber",
    "customernumber", "clientnumber", "membernumber",
    "accountnumber", "bankaccountnumber", "cardnumber", "creditcardnumber",
    "zipcode", "postalcode", "postcode",
    "customername", "clientname", "membername",
    "아이디", "사용자아이디", "고객아이디", "회원아이디",
    "이름", "성명", "성명정보", "고객명", "회원명",
    "전화번호", "휴대폰번호", "핸드폰번호", "연락처", "휴대전화",
    "주소", "거주지주소", "도로명주소", "상세주소",
    "이메일", "이메일주소", "메일주소",
    "주민등록번호", "주민번호", "외국인등록번호",
    "여권번호", "운전면허번호",
    "고객번호", "회원번호", "계좌번호", "카드번호",
    "우편번호",
]

# Texts that mark an identifier wherever they occur in the cleaned name.
IDENTIFIER_PARTS = [
    "phone", "mobile", "telephone", "email", "address", "passport",
    "socialsecurity", "residentregistration", "accountnumber", "cardnumber",
    "전화번호", "휴대폰", "핸드폰", "연락처", "이메일", "주소",
    "주민등록", "주민번호", "외국인등록", "여권번호", "면허번호",
    "계좌번호", "카드번호", "고객번호", "회원번호",
]

NOT_NAME_CHARS = "[^0-9a-zA-Z가-힣]+"


def columns_by_kind(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names; booleans count as categorical."""
    kinds = [(f.name, kind_of(f.dataType)) for f in df.schema.fields if f.name != target]
    return ([c for c, k in kinds if k == "numeric"], [c for c, k in kinds if k in ("text", "boolean")])


def select_features(df: DataFrame, feats: Sequence[str], target: str) -> DataFrame:
    if not feats:
        raise ValueError("choose at least one feature")
    return df.select(*[F.col(f"`{c}`") for c in feats], F.col(f"`{target}`"))


def drop_columns(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    if target in cols:
        raise ValueError("the target column cannot be dropped")
    return df.drop(*cols)


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in cols})


def numeric_cast_errors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, bad_values) where a value is present but is no number."""
    fields = {f.name: f for f in df.schema.fields}
    bad = [F.count_if(~missing(fields[c]) & to_number(F.col(f"`{c}`")).isNull()).alias(c) for c in cols]
    return _long(df.agg(*bad), cols, "bad_values").where("bad_values > 0")


def _long(one_row: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    return one_row.unpivot([], [F.col(f"`{c}`") for c in cols], "column", value)


def check_columns(df: DataFrame, required: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names against the contract."""
    have = set(df.columns)
    return [c for c in required if c not in have], [c for c in df.columns if c not in set(required)]


def null_counts(df: DataFrame) -> DataFrame:
    return _long(df.agg(*[F.count_if(missing(f)).alias(f.name) for f in df.schema.fields]), df.columns, "nulls")


def columns_with_nulls(df: DataFrame) -> DataFrame:
    return null_counts(df).where("nulls > 0")


def non_numeric_columns(df: DataFrame, target: str) -> list[str]:
    """Features a model cannot take; booleans pass as 0/1."""
    return [f.name for f in df.schema.fields
            if f.name != target and kind_of(f.dataType) not in ("numeric", "boolean")]


def binary_target_values(df: DataFrame, target: str) -> list:
    """The two target values in sorted order; an error if there are not exactly two."""
    got = sorted(r[0] for r in df.select(target).dropna().distinct().limit(3).collect())
    if len(got) != 2:
        raise ValueError(f"the target needs exactly two values, found {len(got)}")
    return got


def binarize_target(df: DataFrame, target: str, positive=None) -> DataFrame:
    """1 where the target equals the positive class (default: the second value in sorted order)."""
    if positive is None:
        positive = binary_target_values(df, target)[1]
    return df.withColumn(target, (F.col(f"`{target}`") == F.lit(positive)).cast("int"))


def model_ready(df: DataFrame, target: str) -> DataFrame:
    """All gates before a split; returns the frame with booleans as 0/1."""
    bad = non_numeric_columns(df, target)
    if bad:
        raise ValueError(f"encode these columns first: {bad}")
    holes = [r["column"] for r in columns_with_nulls(df).collect()]      # at most one row per column
    if holes:
        raise ValueError(f"treat missing values first: {holes}")
    binary_target_values(df, target)
    flags = [f.name for f in df.schema.fields if f.name != target and kind_of(f.dataType) == "boolean"]
    return df.withColumns({c: F.col(f"`{c}`").cast("int") for c in flags})


def is_identifier(name: Column) -> Column:
    """True where a column name looks like a direct identifier."""
    lower = F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))
    clean = F.regexp_replace(lower, NOT_NAME_CHARS, "")
    tokens = F.split(lower, NOT_NAME_CHARS)
    return (clean.isin(EXACT_IDENTIFIERS) | F.array_contains(tokens, "id") | F.array_contains(tokens, "name")
            | F.endswith(lower, F.lit("_id")) | F.startswith(lower, F.lit("id_"))
            | clean.rlike("|".join(IDENTIFIER_PARTS)))


def identifier_columns(catalog: DataFrame, name: str = "column_name") -> DataFrame:
    """The catalogue (one row per table and column) with an `is_identifier` flag."""
    return catalog.withColumn("is_identifier", is_identifier(F.col(name)))


def protected_columns(df: DataFrame) -> list[str]:
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    hit = {r[0] for r in identifier_columns(names).where("is_identifier").collect()}   # names only
    return [c for c in df.columns if c in hit]


def protect_identifiers(df: DataFrame) -> DataFrame:
    return df.drop(*protected_columns(df))


def exclusions(protected: Sequence[str], extra: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*protected, *extra]))


def column_catalog(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per table and column, read from the schemas."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString()) for t, df in frames.items()
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
