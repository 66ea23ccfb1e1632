"""URL, evidence and provenance expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.text import strip


def safety_key(url: Column, by_url: bool = False) -> Column:
    """``domain:host`` (or ``url:...``) of an http(s) URL with a host and no user; else null."""
    own = strip(url)
    host = F.regexp_replace(F.lower(F.try_parse_url(own, F.lit("HOST"))), r"\.+$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    valid = F.lower(F.try_parse_url(own, F.lit("PROTOCOL"))).isin("http", "https") & F.try_parse_url(own, F.lit("USERINFO")).isNull() & (host != "")
    return F.when(valid, F.concat(F.lit("url:"), own) if by_url else F.concat(F.lit("domain:"), host))


def url_id(url: Column) -> Column:
    """URL-safe base 64 without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(url, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def evidence_id(url: Column, title: Column) -> Column:
    return F.concat(F.lit("web:"), F.substring(F.sha2(F.coalesce(F.nullif(url, F.lit("")), title), 256), 1, 16))


def evidence_key(kind: Column, url: Column, text: Column) -> Column:
    """Kind with the lower-cased URL, or else with a hash of the stripped lower-cased text."""
    by_text = F.concat(kind, F.lit(":text:"), F.sha2(F.lower(strip(text)), 256))
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(kind, F.lit(":url:"), F.lower(strip(url)))).otherwise(by_text)


def recency(published: Column, start: Column, end: Column) -> Column:
    """recent, not_recent, or unknown for no valid date or window; both ends included."""
    day = F.try_to_date(F.substring(published, 1, 10), "yyyy-MM-dd")
    known = day.isNotNull() & start.isNotNull()
    return F.when(~known, "unknown").when(day.between(start, end), "recent").otherwise("not_recent")


def url_status(malicious: Column, suspicious: Column, http_status: Column) -> Column:
    """Verdict of one reputation answer; what can't be read is an error."""
    return (
        F.when(http_status == 404, "unknown").when(http_status == 429, "rate_limited")
        .when(malicious.isNull() | suspicious.isNull(), "error")
        .when((malicious > 0) | (suspicious > 1), "blocked").otherwise("safe")
    )
