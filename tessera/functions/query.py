"""What a query asks for: expressions over its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, first_of

#: Patterns whose first group is the concept that a definition is sought of, in order.
DEFINITIONS = (
    r"(?i)\bwhat\s+is\s+(?:a\s+|an\s+|the\s+)?(.+?)(?:\?|$)",
    r"(?i)\bdefine\s+(.+?)(?:\?|$)",
    r"(?i)\bexplain\s+(?:what\s+is\s+)?(?:a\s+|an\s+|the\s+)?(.+?)(?:\?|$)",
    r"(?i)\bmeaning\s+of\s+(?:a\s+|an\s+|the\s+)?(.+?)(?:\?|$)",
    r"(?i)\bdescribe\s+(?:what\s+is\s+)?(?:a\s+|an\s+|the\s+)?(.+?)(?:\?|$)",
    r"(?i)(.+?)\s+definition\s*$",
)
#: Words added to a keyword query for each phrase that it holds, in order.
EXPANSIONS = {
    "deadlock": "circular wait hold-and-wait mutual exclusion resource allocation graph",
    "critical section": "race condition mutual exclusion synchronization",
    "paging": "page table page fault virtual memory",
    "segmentation": "segment table segmentation fault memory management",
    "scheduling": "cpu scheduling preemptive non-preemptive round-robin priority",
    "tcp handshake": "three-way handshake 3-way handshake connection establishment syn ack fin",
    "three way handshake": "three-way handshake 3-way handshake connection establishment",
    "udp": "user datagram protocol connectionless",
    "osi model": "osi reference model seven layers 7 layers",
    "routing": "routing algorithms distance vector link state shortest path",
    "congestion control": "tcp congestion window slow start congestion avoidance",
    "acid": "atomicity consistency isolation durability transaction properties",
    "transaction": "commit rollback concurrency serializability schedule",
    "normalization": "functional dependency 1nf 2nf 3nf bcnf",
    "indexing": "b tree b+ tree index selectivity clustered nonclustered",
}
#: Beginnings that a semantic query drops.
SEMANTIC_PREFIXES = ("please explain ", "explain ", "can you explain ", "what do you mean by ", "what is meant by ")
#: Whole messages that need no retrieval; words that refer to what was said before; what joins and parts questions.
GREETING = r"(?i)^(hi|hello|hey|thanks|thank you|bye|ok|yes|no)[\s!?.]*$"
PRONOUNS = r"(?i)\b(it|its|they|them|their|this|that|these|those|the same|above|previous)\b"
MULTI_PART = (" and ", " also ", " then ", "; ", "? ", " versus ", " vs ")
SEPARATORS = (" and ", " also ", " then ", "; ", "? ")
#: What a query holds (one phrase of each group), and what its chunks must not.
NEGATIVE_SIGNALS = (
    ((("tcp",), ("handshake",)), ("tls", "record protocol", "authentication protocol")),
    ((("b+ tree", "b plus tree", "b-tree"),), ("r tree", "generalized search trees")),
    ((("virtual memory",),), ("virtual machines", "virtual machine")),
)
#: Beginnings and phrases of questions about procedures; phrases of comparisons, and two that make one together.
PROCEDURAL_BEGINNINGS = ("how to ", "how do ", "how does ", "explain how ")
PROCEDURAL_PHRASES = (" step by step", "steps to", "algorithm for", "procedure for")
COMPARATIVE_PHRASES = ("compare ", " vs ", " versus ", "difference between")
COMPARATIVE_PAIR = ("advantages of", "over")
#: Words that are no entities.
NO_ENTITY = ("what", "how", "why", "when", "the", "and", "for", "with", "from", "does", "explain", "define", "compare", "difference", "between")


def is_definition(q: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.trim(q).rlike(p) for p in DEFINITIONS))


def concept(q: Column) -> Column:
    """What the first matching pattern asks of; null if none matches or nothing is left."""
    q = F.trim(q)
    raw = first_of(*((q.rlike(p), F.regexp_extract(q, p, 1)) for p in DEFINITIONS), otherwise=F.lit(None).cast("string"))
    return F.nullif(F.trim(F.rtrim(F.trim(raw), F.lit("?"))), F.lit(""))


def negative_signals(q: Column) -> Column:
    low = F.lower(q)
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*(F.when(reduce(lambda a, b: a & b, (contains_any(low, any_of) for any_of in all_of)), F.array(*map(F.lit, signals))).otherwise(none) for all_of, signals in NEGATIVE_SIGNALS)))


def is_procedural(q: Column) -> Column:
    low = F.lower(F.trim(q))
    return reduce(lambda a, b: a | b, (F.startswith(low, F.lit(p)) for p in PROCEDURAL_BEGINNINGS)) | contains_any(low, PROCEDURAL_PHRASES)


def is_comparative(q: Column) -> Column:
    low = F.lower(F.trim(q))
    return contains_any(low, COMPARATIVE_PHRASES) | reduce(lambda a, b: a & b, (F.contains(low, F.lit(p)) for p in COMPARATIVE_PAIR))


def intent(q: Column) -> Column:
    return first_of((is_definition(q), F.lit("definition")), (is_comparative(q), F.lit("comparison")), (is_procedural(q), F.lit("procedural")), otherwise=F.lit("factual"))


def keyword_query(q: Column) -> Column:
    base = F.trim(q)
    return F.concat_ws(" ", base, *(F.when(F.contains(F.lower(base), F.lit(p)), F.lit(more)) for p, more in EXPANSIONS.items()))


def semantic_query(q: Column) -> Column:
    base = F.trim(q)
    low = F.lower(base)
    cut = first_of(*((F.startswith(low, F.lit(p)), F.substr(base, F.lit(len(p) + 1))) for p in SEMANTIC_PREFIXES), otherwise=base)
    return F.trim(F.regexp_replace(cut, r"[ ?]+$", ""))


def needs_retrieval(q: Column) -> Column:
    return (F.trim(q) != "") & ~F.trim(q).rlike(GREETING)


def complexity(q: Column) -> Column:
    return F.when(~F.trim(q).rlike(GREETING) & contains_any(F.trim(q), MULTI_PART), F.lit("multi-part")).otherwise(F.lit("simple"))


def sub_queries(q: Column) -> Column:
    """The parts at the first separator that gives two or more; the whole query if none does or it is simple."""
    q = F.trim(q)
    parts = [F.filter(F.transform(F.split(q, s.replace("?", r"\?")), lambda p: F.trim(p)), lambda p: p != "") for s in SEPARATORS]
    return F.when(complexity(q) == "simple", F.array(q)).otherwise(first_of(*((F.size(p) >= 2, p) for p in parts), otherwise=F.array(q)))


def entities(q: Column) -> Column:
    """The concept, then words longer than two characters that are not question words; distinct, ten at most."""
    words = F.filter(F.regexp_extract_all(q, F.lit(r"[A-Za-z0-9][A-Za-z0-9\-]*"), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*NO_ENTITY))
    return F.slice(F.array_distinct(F.concat(F.when(concept(q).isNotNull(), F.array(concept(q))).otherwise(F.array().cast("array<string>")), words)), 1, 10)


def is_follow_up(q: Column, has_history: Column) -> Column:
    return has_history & F.trim(q).rlike(PRONOUNS)
