"""Photo urls of plants from landed search results: filter, distinct in order, categories, balance, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernglass.functions import text as rules

# Words of titles that are no photos, and of urls that show a detail.
NOT_PHOTOS = ("icon", "map", "logo", "flag")
DETAILS = ("flower", "bloom", "detail", "close")
ENOUGH, KEEP, WIDTH = 6, 3, 800


def is_photo(title: Column) -> Column:
    return ~F.lower(title).rlike("|".join(NOT_PHOTOS))


def resized(url: Column, width: int = WIDTH) -> Column:
    """The url of a thumbnail with its first width replaced."""
    return F.regexp_replace(url, r"\A(.*?)/\d+px-", rf"$1/{width}px-")


def category(url: Column) -> Column:
    return F.when(F.lower(url).rlike("|".join(DETAILS)), "closeup").otherwise("full")


def hits_until_enough(hits: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(search_name, term_idx, hit_idx, url): photos of terms that were still asked for, each url once.

    A term is asked for while fewer than `enough` distinct urls were found before it."""
    kept = hits.where(is_photo(F.col("title")))
    first = Window.partitionBy("search_name", "url").orderBy("term_idx", "hit_idx")
    once = kept.withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")
    per = once.groupBy("search_name", "term_idx").agg(F.count("*").alias("c_"))
    before = F.coalesce(F.sum("c_").over(Window.partitionBy("search_name").orderBy("term_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = per.withColumn("b_", before).where(F.col("b_") < enough).select("search_name", "term_idx")
    return once.join(asked, ["search_name", "term_idx"], "left_semi").select("search_name", "term_idx", "hit_idx", "url")


def balanced(close: Column, full: Column, keep: int = KEEP) -> tuple[Column, Column]:
    """Both lists, an empty one given the other's last url if that has two or more; then the first `keep` of each."""
    take_full = (F.size(close) == 0) & (F.size(full) > 1)
    take_close = (F.size(full) == 0) & (F.size(close) > 1)
    all_but_last = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))
    c = F.when(take_full, F.slice(full, -1, 1)).when(take_close, all_but_last(close)).otherwise(close)
    f = F.when(take_close, F.slice(close, -1, 1)).when(take_full, all_but_last(full)).otherwise(full)
    return F.slice(c, 1, keep), F.slice(f, 1, keep)


def photos(urls: DataFrame, key: str = "search_name", order: str = "ord") -> DataFrame:
    """(key, closeup, full) from (key, order, url): urls once, in order, split by category and balanced."""
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, "url"))), lambda u: u["url"]))
    rows = urls.groupBy(key).agg(listed.alias("urls"))
    close, full = balanced(F.filter("urls", lambda u: category(u) == "closeup"), F.filter("urls", lambda u: category(u) == "full"))
    return rows.select(key, close.alias("closeup"), full.alias("full"))


SUMMARY = "thumbnail struct<source:string>, originalimage struct<source:string>"


def summary_urls(landed: DataFrame, body: str = "body") -> DataFrame:
    """landed with `urls`: the widened thumbnail and the original of an encyclopedia summary; [] where the JSON is bad."""
    parsed = F.from_json(F.col(body), SUMMARY)
    found = F.array(resized(parsed["thumbnail"]["source"]), parsed["originalimage"]["source"])
    return landed.withColumn("urls", F.coalesce(F.filter(found, lambda u: u.isNotNull()), F.array().cast("array<string>")))


PAGES = "query struct<pages:map<string,struct<title:string,imageinfo:array<struct<thumburl:string,url:string>>>>>"  # a map keeps the keys' order


def encoded(term: Column) -> Column:
    """A term as a part of a url, as browsers encode it: spaces as %20; ! ' ( ) * ~ stay."""
    out = F.replace(F.url_encode(term), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def search_terms(names: DataFrame, name: str = "search_name", order: str | None = None) -> DataFrame:
    """(search_name, term_idx, term) of the three searches for each name, once each; `search_name` is the name in lower case without white space around.

    Of names that differ in case or white space the first by `order` is asked for as it is written (without `order` the least)."""
    rows = names.where(F.coalesce(F.col(name), F.lit("")) != "").select(rules.trimmed(F.lower(F.col(name))).alias("search_name"), F.struct(F.col(order or name).alias("o"), F.col(name).alias("n")).alias("s"))
    first = rows.groupBy("search_name").agg(F.min("s")["n"].alias("n"))
    terms = F.array(F.col("n"), F.concat("n", F.lit(" plant")), F.concat("n", F.lit(" flower")))
    return first.select("search_name", F.posexplode(terms).alias("term_idx", "term"))


def search_hits(landed: DataFrame, body: str = "body") -> DataFrame:
    """(search_name, term_idx, hit_idx, title, url) of landed search answers; hits without a url are left out.

    Pages come as browsers list an object's members: whole numbers first, ascending, then other keys as they stand. A null body (no answer)
    gives nothing; one that is no JSON ends its name's searches."""
    spoilt = F.col(body).isNotNull() & F.try_parse_json(body).isNull()
    rows = landed.withColumn("spoilt_", F.min(F.when(spoilt, F.col("term_idx"))).over(Window.partitionBy("search_name"))).where("spoilt_ is null or term_idx < spoilt_")
    number = lambda k: F.when(k.rlike(r"\A(0|[1-9]\d{0,9})\z") & (F.try_to_number(k, F.lit("9999999999")).cast("long") < 4294967295), F.try_to_number(k, F.lit("9999999999")).cast("long"))
    pages = F.transform(F.map_entries(F.from_json(F.col(body), PAGES)["query"]["pages"]), lambda p, i: F.struct(F.coalesce(number(p["key"]), F.lit(1 << 40) + i).alias("at"), p["value"].alias("p")))
    rows = rows.select("search_name", "term_idx", F.posexplode(F.array_sort(pages)).alias("hit_idx", "e")).select("search_name", "term_idx", "hit_idx", "e.p")
    first = F.try_element_at(F.col("p.imageinfo"), F.lit(1))
    url = F.coalesce(F.nullif(first["thumburl"], F.lit("")), F.nullif(first["url"], F.lit("")))
    return rows.select("search_name", "term_idx", "hit_idx", F.coalesce("p.title", F.lit("")).alias("title"), url.alias("url")).where("url is not null")


def fetched(summaries: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_name, closeup, full) from landed encyclopedia summaries (search_name, body) and search answers (search_name, term_idx, body).

    The encyclopedia's images are all full views and come first; search hits are told apart by their urls. Urls are distinct among the search hits.
    Names that only one of the two knows have what it gives, names without any image two empty lists."""
    empty = F.array().cast("array<string>")
    one = summary_urls(summaries).groupBy("search_name").agg(F.max("urls").alias("known"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("term_idx", "hit_idx", "url"))), lambda u: u["url"])
    two = hits_until_enough(search_hits(searches)).groupBy("search_name").agg(listed.alias("hits"))
    names = summaries.select("search_name").unionByName(searches.select("search_name")).distinct()
    rows = names.join(one, "search_name", "left").join(two, "search_name", "left").select("search_name", F.coalesce("known", empty).alias("known"), F.coalesce("hits", empty).alias("hits"))
    close, full = balanced(F.filter("hits", lambda u: category(u) == "closeup"), F.concat("known", F.filter("hits", lambda u: category(u) == "full")))
    return rows.select("search_name", close.alias("closeup"), full.alias("full"))


def all_photos(fetched_: DataFrame) -> DataFrame:
    """(search_name, photos): close-ups, then full views."""
    return fetched_.select("search_name", F.concat("closeup", "full").alias("photos"))
