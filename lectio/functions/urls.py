"""URLs: normal forms, domains, redirects, cache keys and query additions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/?#:@\s]+)(?::[0-9]*)?([^?#\s]*)(\?[^#\s]*)?(?:#.*)?$"

# Domains whose pages are preferred.
SCHOLARLY_DOMAINS = (
    "plato.stanford.edu", "iep.utm.edu", "jstor.org", "academia.edu", "philpapers.org", "scholar.google.com", "arxiv.org", "doi.org",
    "researchgate.net", "semanticscholar.org", "philarchive.org", "ssrn.com",
    "newadvent.org", "corpusthomisticum.org", "dhspriory.org", "aquinas.cc", "ccel.org", "fordham.edu", "vatican.va",
    "documenta-catholica.eu", "catholicculture.org", "stthomas.edu", "thomisticcommentary.org", "isidore.co", "liturgica.com",
    "orthodoxwiki.org", "oca.org", "pravoslavie.ru", "myriobiblos.gr", "tertullian.org", "earlychurchtexts.com",
    "carm.org", "monergism.com", "theopedia.com", "desiringgod.org", "ligonier.org", "thegospelcoalition.org", "etsjets.org",
    "biblicalstudies.org.uk", "reformedtheology.org", "frame-poythress.org",
    "biblegateway.com", "blueletterbible.org", "biblehub.com", "deadseascrolls.org.il", "sacred-texts.com", "earlyjewishwritings.com",
    "earlyapostolicfathers.com", "perseus.tufts.edu", "loebclassics.com", "thelatinlibrary.com",
    "philosophybasics.com", "philosophynow.org", "partiallyexaminedlife.com", "earlymoderntexts.com", "gutenberg.org", "marxists.org",
    "cambridge.org", "oxfordscholarship.com", "academic.oup.com", "journals.sagepub.com", "springer.com", "tandfonline.com", "brill.com",
    "degruyter.com", "muse.jhu.edu",
    "britannica.com", "en.wikipedia.org", "oxfordreference.com", "catholicdistance.org",
)


def part(url: Column, group: int) -> Column:
    """Scheme (1), host without port (2), path (3) or query (4) of an absolute url; "" where absent or malformed."""
    return F.regexp_extract(url, _ABSOLUTE, group)


def is_absolute(url: Column) -> Column:
    return F.coalesce(url.rlike(_ABSOLUTE), F.lit(False))


def host(url: Column) -> Column:
    """Host in small letters, null where the url is malformed."""
    return F.nullif(F.lower(part(url, 2)), F.lit(""))


def dedupe_key(url: Column) -> Column:
    """What spellings of one address share: https, no leading www., no port, fragment or closing slash, small letters."""
    bare = F.regexp_replace(part(url, 2), r"(?i)^www\.", "")
    key = F.lower(F.concat(F.lit("https://"), bare, F.regexp_replace(part(url, 3), "/+$", ""), part(url, 4)))
    return F.when(F.trim(url) == "", url).when(is_absolute(url), key).otherwise(F.lower(F.regexp_replace(url, "/+$", "")))


def seed(url: Column) -> Column:
    """A start address: https where no scheme is given, no closing slashes."""
    full = F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(full, "/+$", "")


def domain(url: Column) -> Column:
    """The host to show: without any ``www.``; null where malformed."""
    return F.replace(host(url), F.lit("www."), F.lit(""))


def is_scholarly(url: Column, domains: tuple[str, ...] = SCHOLARLY_DOMAINS) -> Column:
    """Whether the host is a preferred domain or below one. The host's suffixes are compared with a literal set."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.coalesce(F.arrays_overlap(suffixes, F.array(*(F.lit(d) for d in domains))), F.lit(False))


def unwrap_redirect(href: Column) -> Column:
    """The target of a search engine's redirect; an absolute web address stays; else ""."""
    inner = F.regexp_extract(href, r"[?&]uddg=([^&]+)", 1)
    return (
        F.when(inner != "", F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B"))))
        .when(href.rlike("(?i)^https?://"), href)
        .otherwise("")
    )


def augment_query(query: Column) -> Column:
    """The query with words that lean results to the field, unless it already has such a word."""
    return F.when(F.lower(query).rlike("scholar|academic|journal|paper|site:"), query).otherwise(F.concat(query, F.lit(" scholarly theology philosophy")))


def cache_key(mode: Column, top_n: Column, query: Column) -> Column:
    return F.concat_ws(":", F.lit("search"), mode, top_n.cast("string"), F.lower(F.trim(query)))


def resolve(base: Column, href: Column) -> Column:
    """``href`` as an absolute web address without fragment, seen from ``base``; null where it is no web link."""
    h = F.trim(href)
    root = F.lower(F.concat(part(base, 1), F.lit("://"), part(base, 2)))
    folder = F.regexp_extract(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), r"^(.*/)", 1)
    bare = F.regexp_replace(h, "#.*$", "")
    full = (
        F.when(h.rlike("(?i)^https?://"), bare)
        .when(h.rlike("^//"), F.concat(part(base, 1), F.lit(":"), bare))
        .when(h.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:") | (h == "") | h.startswith("#"), None)
        .when(h.startswith("/"), F.concat(root, bare))
        .when(h.startswith("?"), F.concat(root, part(base, 3), bare))
        .otherwise(F.concat(root, folder, bare))
    )
    path = F.when(part(full, 3) == "", "/").otherwise(part(full, 3))
    return F.when(is_absolute(full), F.concat(F.lower(F.concat(part(full, 1), F.lit("://"), part(full, 2))), path, part(full, 4)))
