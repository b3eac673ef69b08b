"""The convenience rules as SQL functions of a session (native expressions), and claims as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

from turnout.functions.claims import ClaimsOf

_KEYS = "array('utm_source', 'utm_medium', 'utm_campaign', 'utm_content')"
_PAIRS = ("transform(filter(split(regexp_extract(split_part(url, '#', 1), r'^[^?]*[?](.*)$', 1), '&'), p -> p rlike '^[^=]*=.+$'), "
          "p -> named_struct('k', url_decode(regexp_extract(p, '^([^=]*)=', 1)), 'v', url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1))))")
_NEW = "map('utm_source', source, 'utm_medium', medium, 'utm_campaign', campaign, 'utm_content', content)"

FUNCTIONS = {
    "norm_name(s STRING)": r"array_join(transform(split(regexp_replace(s, r'(?U)^\s+|\s+$', ''), r'(?<=[\s-])'), p -> initcap(p)), '')",
    "company_key(s STRING)": r"regexp_replace(lower(regexp_replace(s, r'(?U)^\s+|\s+$', '')), r'(?U)\s+', ' ')",
    "is_filled(s STRING)": "coalesce(trim(s), '') NOT IN ('', 'Unknown', '0')",
    "with_utm(url STRING, source STRING, medium STRING, campaign STRING, content STRING)":
        f"split_part(split_part(url, '#', 1), '?', 1) || '?' || array_join(transform(array_distinct(concat(transform({_PAIRS}, p -> p.k), {_KEYS})), "
        f"k -> url_encode(k) || '=' || url_encode(coalesce(try_element_at({_NEW}, k), element_at(filter({_PAIRS}, p -> p.k = k), -1).v))), '&') || "
        "if(regexp_extract(url, '#(.*)$', 1) = '', '', '#' || regexp_extract(url, '#(.*)$', 1))",
}


def register(spark: SparkSession) -> None:
    """Make norm_name, company_key, is_filled, with_utm and the table function claims_of callable from spark.sql."""
    for signature, body in FUNCTIONS.items():
        returns = "BOOLEAN" if signature.startswith("is_") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")
    spark.udtf.register("claims_of", ClaimsOf)
