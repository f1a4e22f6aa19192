"""Text expressions: normalisation, query preparation, index keys, classifiers, name candidates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on: patterns of the classifiers and extractors.
PROMISE = (r"\b(i will|i'll|will\s+(?:finish|deliver|do|close|complete|implement|deploy|ship|fix|provide|send|schedule)"
           r"|going to\s+(?:finish|deliver|do|close|complete|implement|deploy|ship|fix|provide|send|schedule))\b")
METRIC = r"\b(ARR|MRR|NRR|revenue|churn|ROI|LTV|CAC|NPS|EBITDA)\b|\$\d"
DECISION = r"(^|\b)(decision:|решение:|решено:|decided|decision|approved|rejected|agreed|signed|confirmed)\b"
TASK = r"(^|\b)(task:|задача:|todo|action item|assigned to|needs to|must|should)\b"
STATUS = r"\b(status|update|completed|done|in progress|blocked|stalled|заглохла|готово|подписан)\b"
REQUIREMENT = r"\b(requirement|requirements|req|issue)\b|\b\d{5,}\b"
NAME = r"[\p{Lu}][\p{Ll}]+(?:\s+[\p{Lu}][\p{Ll}]+)+|[\p{Lu}][\p{L}\p{N}]{2,}"
MONTH_YEAR = r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\b"
ISO_DATE = r"\b\d{4}-\d{2}(?:-\d{2})?\b"
EPISODE_REF = r"episode:[a-z0-9_-]+"
COMPANY = ("Corp Inc Ltd LLC GmbH AG SA PLC Company Group Systems Technologies Solutions Labs Studio Partners Associates "
           "Holdings Foundation Institute University Academy Limited").split()
EVENT = "Conference Summit Meetup Hackathon Workshop Festival Ceremony Award Championship Olympics".split()
PLACE = "City County State Province Country District Region Territory Island".split()
RELATIONSHIP = ("who knows", "introduce", "connected to", "relationship", "knows who", "mutual", "connection")
#: A short default gazetteer; the full one is a parameter of classify_entity.
LOCATIONS = ("New York", "Los Angeles", "Chicago", "San Francisco", "Seattle", "Boston", "London", "Paris", "Berlin", "Madrid",
             "Rome", "Moscow", "Tokyo", "Beijing", "Sydney", "Toronto", "Germany", "France", "Spain", "Italy", "Russia", "Japan")
OBSERVATION_CHARS = 50


def normalize(x: Column | str) -> Column:
    """Words joined by one space, lower case."""
    c = F.col(x) if isinstance(x, str) else x
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def optional_string(x: str) -> Column:
    """Trimmed; empty or "null" is null."""
    t = F.trim(F.col(x))
    return F.when((t == "") | (F.lower(t) == "null"), None).otherwise(t)


def tokens(x: Column | str) -> Column:
    """Runs of letters or digits in lower case: a class change ends a token."""
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z]+|[0-9]+)"), F.lit(1))


def search_query(x: Column | str) -> Column:
    """A query without episode references, quotes, OR/AND/NOT and words below two bytes."""
    c = F.col(x) if isinstance(x, str) else x
    c = F.regexp_replace(c, "(?i)" + EPISODE_REF, " ")
    c = F.regexp_replace(c, '"([^"]*)"', " $1 ")
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: ~F.upper(w).isin("OR", "AND", "NOT") & (F.octet_length(w) >= 2))
    return F.array_join(words, " ")


def search_query_text(query: str) -> str:
    """The same for one query on the driver."""
    s = re.sub("(?i)" + EPISODE_REF, " ", query)
    s = re.sub(r'"([^"]*)"', r" \1 ", s)
    return " ".join(w for w in s.split() if w.upper() not in ("OR", "AND", "NOT") and len(w.encode()) >= 2)


def temporal_expansions(query: str, as_of: dt.datetime | None) -> list[str]:
    """The query, and with "last month" / "this month" as month and year of as_of."""
    out = [query]
    if as_of is None:
        return out
    last = (as_of.replace(day=1) - dt.timedelta(days=1))
    for phrase, when in (("last month", last), ("this month", as_of)):
        if phrase in query.lower():
            name = when.strftime("%B %Y")
            new = query.replace(phrase, name).replace(phrase.capitalize(), name)
            if new != query:
                out.append(new)
    return out


def query_ngrams(query: str) -> list[str]:
    """All spans of words, longest first, of two bytes or more."""
    words = query.split()
    spans = [" ".join(words[a:a + n]) for n in range(len(words), 0, -1) for a in range(len(words) - n + 1)]
    return [s for s in spans if len(s.encode()) >= 2]


def is_relationship_query(query: str) -> bool:
    return any(p in query.lower() for p in RELATIONSHIP)


def index_keys(content: str, t_valid: str) -> Column:
    """Months and dates named in the content, and the month of t_valid, sorted and distinct."""
    own = F.array(F.lower(F.date_format(t_valid, "MMMM yyyy")), F.date_format(t_valid, "yyyy-MM"))
    months = F.transform(F.regexp_extract_all(content, F.lit("(?i)(" + MONTH_YEAR + ")"), F.lit(1)), lambda m: normalize(m))
    dates = F.regexp_extract_all(content, F.lit("(" + ISO_DATE + ")"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(own, months, dates)))


def _like(x: Column, pattern: str, flags: str = "(?U)") -> Column:
    return x.rlike(flags + pattern)


#: The classifiers as SQL's regexp_matches reads them: English keywords, words of ASCII letters, digits and _ alone.
_PLAIN = {"promise": PROMISE, "metric": METRIC, "decision": r"\b(decided|decision|approved|rejected|agreed|signed|confirmed)\b",
          "task": r"\b(todo|action item|assigned to|needs to|must|should)\b", "status": r"\b(status|update|completed|done|in progress|blocked|stalled)\b", "requirement": REQUIREMENT}


def _plain_words(pattern: str, flags: str = "") -> str:
    """The pattern with edges of ASCII words and ASCII space, whatever Java's release takes \\b for."""
    return flags + pattern.replace(r"\b", r"(?-iu:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))").replace(r"\s", r"[\t\n\f\r ]")


def fact_types(content: str, plain: bool = False) -> Column:
    """The types of fact that a text states; an observation if none and it has 50 characters or more. Letters of any
    alphabet make a word; plain: as SQL's regexp_matches has it, where Ñ ends one and only English keywords count."""
    c = F.col(content)
    low = F.lower(c)

    def gate(x: Column, words: str) -> Column:
        """Any of the substrings, without which a pattern cannot match: far cheaper than a Unicode pattern."""
        test = F.lit(False)
        for w in words.split("|"):
            test = test | x.contains(w)
        return test

    tests = (("promise", gate(low, "i'll|will|going to") & _like(low, PROMISE)),
             ("metric", gate(c, "ARR|MRR|NRR|revenue|churn|ROI|LTV|CAC|NPS|EBITDA|$") & _like(c, METRIC)),
             ("decision", gate(low, "decision|решен|decided|approved|rejected|agreed|signed|confirmed") & _like(c, DECISION, "(?iU)")),
             ("task", gate(low, "task:|задача:|todo|action item|assigned to|needs to|must|should") & _like(c, TASK, "(?iU)")),
             ("status", gate(low, "status|update|completed|done|in progress|blocked|stalled|заглохла|готово|подписан") & _like(c, STATUS, "(?iU)")),
             ("requirement", (gate(low, "req|issue") | c.rlike(r"[0-9]{5}") | c.rlike(r"[^\x00-\x7F]")) & _like(c, REQUIREMENT, "(?iU)")))
    if plain:  # a long s folds to s
        gates = {"promise": gate(low, "i'll|will|going to"), "metric": gate(c, "ARR|MRR|NRR|revenue|churn|ROI|LTV|CAC|NPS|EBITDA|$"), "decision": gate(low, "decision|decided|approved|rejected|agreed|signed|confirmed|ſ"),
                 "task": gate(low, "todo|action item|assigned to|needs to|must|should|ſ"), "status": gate(low, "status|update|completed|done|in progress|blocked|stalled|ſ"), "requirement": gate(low, "req|issue|ſ") | c.rlike(r"[0-9]{5}")}
        own = {"promise": low.rlike(_plain_words(PROMISE)), "metric": c.rlike(_plain_words(METRIC))}
        tests = [(name, gates[name] & own.get(name, c.rlike(_plain_words(p, "(?iu)")))) for name, p in _PLAIN.items()]
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests]))
    observed = F.when(F.char_length(F.trim(c)) >= OBSERVATION_CHARS, F.array(F.lit("observation"))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(found) > 0, found).otherwise(observed)


def name_candidates(content: str) -> Column:
    """Capitalised names, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(content, F.lit("(" + NAME + ")"), F.lit(1))))


def is_acronym(x: Column) -> Column:
    return x.rlike(r"^[\p{Lu}0-9.\-/_]+$") & (F.octet_length(x) >= 3)


def classify_entity(name: Column, locations=LOCATIONS) -> Column:
    """company, event, location, person (two words or more), technology or unknown, in this order. `locations`
    is the gazetteer."""

    def holds(words) -> Column:
        test = F.lit(False)
        for w in words:
            test = test | name.contains(w)
        return test

    return (F.when(holds(COMPANY), "company").when(holds(EVENT), "event").when(holds(PLACE) | name.isin(*locations), "location")
            .when(F.size(F.split(F.trim(name), r"\s+")) >= 2, "person").when(name.rlike(r"^\p{Lu}"), "technology").otherwise("unknown"))
