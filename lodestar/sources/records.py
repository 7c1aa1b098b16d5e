"""Per-source normalisers: declared payload schemas projected to one record of eighteen columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scalar as S
from lodestar.sources.feeds import comment_header

#: The record every source is normalised to.
COLUMNS = ("platform", "company_token", "company_name", "source_id", "title", "location_raw", "department", "job_url", "posted_at", "posted_at_ts", "salary_text", "seniority_guess", "location_is_nyc", "location_is_remote", "company_is_nyc_hq", "company_is_ai_focused", "description_text", "raw_json")

#: Declared payloads; nothing is inferred.
SCHEMAS = {
    "greenhouse": "id bigint, title string, updated_at string, first_published string, location struct<name:string>, departments array<struct<name:string>>, content string, absolute_url string",
    "lever": "id string, text string, createdAt bigint, categories struct<location:string,team:string,allLocations:array<string>>, hostedUrl string, descriptionPlain string, workplaceType string",
    "ashby": "id string, title string, publishedAt string, location string, department string, jobUrl string, descriptionPlain string, isRemote boolean, compensation struct<compensationTierSummary:string,scrapeableCompensationSalarySummary:string>",
    "workable": "shortcode string, title string, published_on string, city string, state string, country string, telecommuting boolean, department string, url string, description string",
    "recruitee": "id bigint, title string, created_at string, location string, department string, careers_url string, description string, requirements string, remote boolean, salary struct<min:double,max:double,currency:string,period:string>",
    "smartrecruiters": "id string, name string, releasedDate string, location struct<city:string,region:string,country:string,remote:boolean>, department struct<label:string>, ref string, jobAd struct<sections:struct<companyDescription:struct<text:string>,jobDescription:struct<text:string>,qualifications:struct<text:string>,additionalInformation:struct<text:string>>>",
    "workday": "externalPath string, title string, postedOn string, locationsText string, remoteType string, bulletFields array<string>",
    "nyc_open_data": "job_id string, business_title string, agency string, posting_date string, post_until string, work_location string, job_category string, salary_range_from string, salary_range_to string, salary_frequency string, job_description string",
    "weworkremotely": "guid string, title string, pubDate string, region string, category string, link string, description string",
    "builtin_nyc": "company string, title string, location string, level string, remote string, url string, posted string, description string",
    "hn_whoishiring": "id bigint, time bigint, text string",
    "fixture": "id string, title string, location string, department string, url string, posted_at string, description string, remote boolean",
    "google_jobs": "job_id string, title string, company_name string, location string, description string, share_link string, detected_extensions struct<posted_at:string,salary:string,work_from_home:boolean>",
}


#: Listing levels and the guess they stand for.
LISTED_LEVELS = {"entry level": "entry", "junior": "entry", "mid level": "mid_or_unspecified", "senior level": "senior", "expert/leader": "senior"}


def _text(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))


def _parts(*cs: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(F.trim(c), F.lit("")) for c in cs]), F.lit(""))


def _fields(platform: str, p: Column) -> dict[str, Column]:
    """What is special about each source; columns left out are null."""
    g = p.getField
    if platform == "greenhouse":
        # the shown date is the update, the instant the first publication; content arrives escaped one level deeper than elsewhere
        return {"source_id": g("id").cast("string"), "title": g("title"), "location_raw": g("location")["name"], "department": F.get(g("departments"), F.lit(0))["name"], "job_url": g("absolute_url"), "posted_at": F.coalesce(g("updated_at"), g("first_published")), "posted_at_ts": F.coalesce(g("first_published"), g("updated_at")), "description_text": S.strip_html(S.unescape_html(g("content")))}
    if platform == "lever":
        at = F.date_format(F.timestamp_millis(g("createdAt")), "yyyy-MM-dd'T'HH:mm:ss")
        loc = F.coalesce(g("categories")["location"], F.nullif(F.array_join(g("categories")["allLocations"], ", "), F.lit("")))
        return {"source_id": g("id"), "title": g("text"), "location_raw": loc, "department": g("categories")["team"], "job_url": g("hostedUrl"), "posted_at": at, "posted_at_ts": at, "description_text": _text(g("descriptionPlain")), "remote": g("workplaceType") == "remote"}
    if platform == "ashby":
        pay = F.coalesce(g("compensation")["compensationTierSummary"], g("compensation")["scrapeableCompensationSalarySummary"])
        return {"source_id": g("id"), "title": g("title"), "location_raw": g("location"), "department": g("department"), "job_url": g("jobUrl"), "posted_at": g("publishedAt"), "posted_at_ts": g("publishedAt"), "salary_text": pay, "description_text": _text(g("descriptionPlain")), "remote": g("isRemote")}
    if platform == "workable":
        return {"source_id": g("shortcode"), "title": g("title"), "location_raw": _parts(g("city"), g("state"), g("country")), "department": g("department"), "job_url": g("url"), "posted_at": g("published_on"), "posted_at_ts": g("published_on"), "description_text": S.strip_html(g("description")), "remote": g("telecommuting")}
    if platform == "recruitee":
        s = g("salary")
        pay = F.concat_ws(" ", s["currency"], F.nullif(F.concat_ws("-", s["min"].cast("bigint").cast("string"), s["max"].cast("bigint").cast("string")), F.lit("")), F.concat(F.lit("per "), s["period"]))
        return {"source_id": g("id").cast("string"), "title": g("title"), "location_raw": g("location"), "department": g("department"), "job_url": g("careers_url"), "posted_at": g("created_at"), "posted_at_ts": g("created_at"), "salary_text": F.when(s["min"].isNotNull() | s["max"].isNotNull(), pay), "description_text": S.strip_html(F.concat_ws("\n", g("description"), g("requirements"))), "remote": g("remote")}
    if platform == "smartrecruiters":
        sec = g("jobAd")["sections"]
        body = F.concat_ws("\n", *[sec[x]["text"] for x in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")])
        loc = g("location")
        return {"source_id": g("id"), "title": g("name"), "location_raw": _parts(loc["city"], loc["region"], loc["country"]), "department": g("department")["label"], "job_url": g("ref"), "posted_at": g("releasedDate"), "posted_at_ts": g("releasedDate"), "description_text": S.strip_html(body), "remote": loc["remote"]}
    if platform == "workday":
        return {"source_id": g("externalPath"), "title": g("title"), "location_raw": g("locationsText"), "job_url": g("externalPath"), "posted_at": g("postedOn"), "flags": S.location_flags(g("locationsText"), g("remoteType"))}
    if platform == "nyc_open_data":
        pay = F.concat(F.lit("$"), F.format_number(g("salary_range_from").try_cast("double"), 0), F.lit(" - $"), F.format_number(g("salary_range_to").try_cast("double"), 0), F.lit(" "), F.coalesce(g("salary_frequency"), F.lit("")))
        return {"source_id": g("job_id"), "title": g("business_title"), "location_raw": g("work_location"), "department": g("job_category"), "posted_at": g("posting_date"), "posted_at_ts": g("posting_date"), "salary_text": F.trim(pay), "description_text": _text(g("job_description")), "nyc": F.lit(True)}
    if platform == "weworkremotely":
        at = F.date_format(F.try_to_timestamp(F.substring(g("pubDate"), 6, 100), F.lit("dd MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd'T'HH:mm:ss")
        cut = F.instr(g("title"), ": ")
        return {"source_id": g("guid"), "title": F.when(cut > 0, F.substr(g("title"), cut + 2)).otherwise(g("title")), "company_name": F.when(cut > 0, F.substr(g("title"), F.lit(1), cut - 1)), "location_raw": g("region"), "department": g("category"), "job_url": g("link"), "posted_at": at, "posted_at_ts": at, "description_text": S.strip_html(g("description")), "remote": F.lit(True)}
    if platform == "google_jobs":
        ext = g("detected_extensions")
        return {"source_id": S.search_source_id(g("job_id"), F.lit(None).cast("string"), g("title"), S.normalize_url(g("share_link"))), "title": g("title"), "company_name": g("company_name"), "location_raw": g("location"), "job_url": g("share_link"), "posted_at": ext["posted_at"], "salary_text": ext["salary"], "description_text": _text(g("description")), "remote": ext["work_from_home"]}
    if platform == "builtin_nyc":
        return {"source_id": g("url"), "title": g("title"), "company_name": g("company"), "location_raw": g("location"), "job_url": g("url"), "posted_at": g("posted"), "description_text": _text(g("description")), "remote": g("remote").rlike("(?i)remote"), "level": F.element_at(F.create_map(*[F.lit(x) for kv in LISTED_LEVELS.items() for x in kv]), F.lower(g("level")))}
    if platform == "hn_whoishiring":
        company, title = comment_header(g("text"))
        at = F.date_format(F.timestamp_seconds(g("time")), "yyyy-MM-dd'T'HH:mm:ss")
        return {"source_id": g("id").cast("string"), "title": title, "company_name": company, "location_raw": S.strip_html(F.split(g("text"), "<p>")[0]), "job_url": F.concat(F.lit("item?id="), g("id").cast("string")), "posted_at": at, "posted_at_ts": at, "description_text": S.strip_html(g("text"))}
    if platform == "fixture":
        return {"source_id": g("id"), "title": g("title"), "location_raw": g("location"), "department": g("department"), "job_url": g("url"), "posted_at": g("posted_at"), "posted_at_ts": g("posted_at"), "description_text": g("description"), "remote": g("remote")}
    raise ValueError(f"no normaliser for {platform!r}")


def normalize(payloads: DataFrame, platform: str, raw: str = "raw_json") -> DataFrame:
    """Records of one source from (company_token, company_name, ``raw`` JSON text) rows; malformed payloads give nulls."""
    x = payloads.withColumn("__p", F.from_json(raw, SCHEMAS[platform]))
    f = _fields(platform, F.col("__p"))
    nyc, remote = S.classify_location(f.get("location_raw", F.lit(None).cast("string")))
    if "flags" in f:
        nyc, remote = f["flags"]
    if "remote" in f:
        remote = remote | F.coalesce(f["remote"], F.lit(False))
    if "nyc" in f:
        nyc = f["nyc"]
    made = {"platform": F.lit(platform), "company_token": F.col("company_token"), "company_name": f.get("company_name", F.col("company_name")), "seniority_guess": F.coalesce(f["level"], S.guess_seniority(f["title"])) if "level" in f else S.guess_seniority(f["title"]), "location_is_nyc": nyc, "location_is_remote": remote, "raw_json": F.col(raw)}
    kinds = {c: "boolean" for c in COLUMNS if "_is_" in c}
    out = {c: made.get(c, f.get(c, F.lit(None))).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS}
    return x.select(*[out[c] for c in COLUMNS])


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """All sources' records; every source must have all columns."""
    return reduce(lambda a, b: a.unionByName(b), parts)
