"""Task tokens: the words of prompts, commands, paths and names that say what a task is about, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of Chinese, Japanese and Korean words.
CJK = "㐀-䶿一-鿿぀-ヿ가-힯"
RUN = f"[A-Za-z0-9]+|[{CJK}]+"
#: Words that say nothing of a task, and file endings.
STOP = tuple(
    """a an the and or to of in on for with from this that please just can you we it is be at as by fix add make update implement change
    run check try test tests cargo npm yarn pnpm pytest jest nextest ctx exec shell bash sh zsh python python3 node src lib mod use pub
    async fn impl struct error failed pass passed ok stdout stderr 的 了 和 或 在 是 把 被 让 请 我 你 这 那 什么 怎么 可以 一下 这个
    那个 我们 帮我 以及 或者 但是 如果 因为 所以 rs py ts js go tsx jsx toml json""".split()
)
MOST = 16
#: Characters in which tokens are looked for first.
HEADS = (256, 2048)


def _of_run(run: Column) -> Column:
    """Latin runs: the whole, then its parts where case changes. Others: up to six characters whole, then pairs of neighbours."""
    parted = F.regexp_replace(F.regexp_replace(run, "([a-z])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    pieces = F.filter(F.split(F.lower(parted), " "), lambda p: F.char_length(p) >= 2)
    latin = F.when(parted.contains(" "), F.concat(F.array(F.lower(run)), pieces)).otherwise(F.array(F.lower(run)))
    n = F.char_length(run)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2)))
    other = F.when(n <= 6, F.concat(F.array(run), pairs)).otherwise(pairs)
    return F.when(run.rlike("^[A-Za-z0-9]"), latin).otherwise(other)


def _worth(token: Column) -> Column:
    n, plain = F.char_length(token), token.rlike(r"^[\x00-\x7F]*$")
    return ((n >= 3) | (~plain & (n >= 2)) | token.rlike("^e[0-9]?$")) & ~token.isin(*STOP)


def _first_tokens(text: Column, most: int) -> Column:
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return F.slice(F.array_distinct(F.filter(F.flatten(F.transform(runs, _of_run)), _worth)), 1, most)


def task_tokens(text: Column, most: int = MOST) -> Column:
    """The first ``most`` distinct tokens of a text, in its order; none for a null one.

    Most texts have them in their first characters: more is only read where these hold too few.
    """
    text = F.coalesce(text, F.lit(""))
    found = _first_tokens(text, most)
    for n in reversed(HEADS):
        # The run at the end of a head may go on behind it, so it doesn't count.
        head = F.when(F.char_length(text) <= n, text).otherwise(F.regexp_replace(F.left(text, F.lit(n)), f"(?:[A-Za-z0-9]++|[{CJK}]++)$", ""))
        more = found
        # An array of one, so that the head's tokens have a name and are worked out once.
        found = F.get(F.transform(F.array(_first_tokens(head, most)), lambda t: F.when((F.size(t) >= most) | (F.char_length(text) <= n), t).otherwise(more)), F.lit(0))  # noqa: B023
    return found


def merged_tokens(old: Column, new: Column) -> Column:
    """Tokens of both, the new ones first."""
    return task_tokens(F.concat_ws(" ", new, old))


def token_overlap(page: Column, asked: Column) -> Column:
    """Weight of the asked tokens that equal, hold or are held in a token of the page; longer ones weigh more."""

    def hits(q: Column) -> Column:
        held = lambda p: (F.char_length(p) >= 2) & (F.char_length(q) >= 2) & (p.contains(q) | q.contains(p))
        return F.exists(page, lambda p: (p == q) | held(p))

    n = F.char_length
    return F.aggregate(asked, F.lit(0), lambda s, q: s + F.when(~hits(q), 0).when(n(q) <= 2, 1).when(n(q) <= 5, 2).otherwise(3))
