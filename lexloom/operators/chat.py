"""Conversation history: cards, latest turns, session changes."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions.text import ALPHABET, lookup, preview, slug, wide_slug


def session_cards(sessions: DataFrame, messages: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions with message count and a preview of the first user message; messages aggregate before the join."""
    m = messages.groupBy("session_id").agg(
        F.count("*").alias("n_messages"), F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn"))).alias("_first"),
    )
    x = sessions.join(m, "session_id", "left").select(
        "session_id", "user_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Nova conversa")).alias("title"),
        F.coalesce("n_messages", F.lit(0)).cast("long").alias("n_messages"), F.coalesce(preview(F.col("_first"), 50), F.lit("")).alias("preview"), "updated_at", slug(F.col("session_id")).alias("slug"),
    )
    return x.orderBy(F.col("updated_at").desc(), F.col("session_id").desc()).limit(limit) if limit else x


def last_messages(messages: DataFrame, n: int = 25) -> DataFrame:
    """The last n turns of every session, oldest first within a session, with has_more."""
    w = W.partitionBy("session_id")
    x = messages.withColumn("_r", F.row_number().over(w.orderBy(F.col("turn").desc()))).withColumn("has_more", F.count("*").over(w) > n)
    return x.filter(F.col("_r") <= n).drop("_r").sortWithinPartitions("session_id", "turn")


def latest(messages: DataFrame, role: str) -> DataFrame:
    """The last message of a role in each session: a map-side combined max, no sort."""
    m = messages.filter(F.col("role") == role)
    return m.groupBy("session_id").agg(F.max("turn").alias("turn"), F.max_by("content", "turn").alias("content"))


def message_cards(messages: DataFrame) -> DataFrame:
    """Sources only where the assistant speaks, else an empty list."""
    none = F.array().cast("array<string>")
    x = messages.withColumn("sources", F.when(F.col("role") == "assistant", F.coalesce("sources", none)).otherwise(none))
    return x.withColumn("n_sources", F.size("sources").cast("long"))


# Display names of roles.
ROLE_NAMES = {"user": "Usuário", "assistant": "Assistente"}


def message_labels(messages: DataFrame) -> DataFrame:
    return messages.withColumn("label", F.concat(lookup(F.col("role"), ROLE_NAMES, F.col("role")), F.lit(": "), preview(F.col("content"), 50)))


def one_active(sessions: DataFrame) -> DataFrame:
    last = W.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("session_id").desc())
    return sessions.withColumn("is_active", F.row_number().over(last) == 1)


def delete_sessions(sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sessions.join(gone, "session_id", "left_anti"), messages.join(gone, "session_id", "left_anti")


def regenerate(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """Replaces the last assistant turn of each session that ``answers`` (session_id, content) names."""
    old = latest(messages, "assistant").select("session_id", "turn").join(answers.select("session_id"), "session_id", "left_semi")
    kept = messages.join(old, ["session_id", "turn"], "left_anti")
    new = answers.join(messages.groupBy("session_id").agg((F.max("turn") + 1).alias("turn")), "session_id")
    return kept.unionByName(new.select("session_id", "turn", F.lit("assistant").alias("role"), "content"))


def get_or_create(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """(request_id, user_id, session_id, created, title): the asked session if the user owns it, else the user's latest, else a new
    one, titled by the first 50 characters of the question."""
    own = sessions.select("user_id", F.col("session_id").alias("asked"), F.col("session_id").alias("_own"))
    last = sessions.groupBy("user_id").agg(F.max_by("session_id", F.struct("updated_at", "session_id")).alias("_last"))
    x = requests.join(own, ["user_id", "asked"], "left").join(last, "user_id", "left")
    found = F.coalesce("_own", "_last")
    title = F.when(found.isNull(), F.substring("question", 1, 50))
    return x.select("request_id", "user_id", F.coalesce(found, -F.col("request_id") - 1).alias("session_id"), found.isNull().alias("created"), title.alias("title"))


def unique_slugs(sessions: DataFrame, taken: DataFrame, keep, length: int = 12) -> DataFrame:
    """(session_id, slug): a slug of its own for every session (distinct ids), none of those ``taken`` (slug).

    Every round proposes a slug that the id and the round's number decide. The smallest id of those that propose the same
    gets it, if nobody has it; the others try again, until none is left. Where all would fill more than half of the slugs
    of hex characters, those who try again draw from letters of both cases and digits. ``keep`` writes a table down. More
    sessions than there are slugs of these are an error.
    """
    given, left, n = taken.select("slug").distinct(), sessions.select("session_id"), 0
    wanted = sessions.count() + given.count()
    wide = 2 * wanted > 16**length and length <= 16
    if wanted > (len(ALPHABET) if wide else 16) ** length:
        raise ValueError(f"slugs of {length} characters are too short")
    done = None
    while not left.isEmpty():
        ident, salt = F.col("session_id"), f"chat{n or ''}"
        asked = keep(left.withColumn("slug", wide_slug(ident, salt, length) if wide and n else F.substring(slug(ident, salt), 1, length)))
        won = keep(asked.groupBy("slug").agg(F.min("session_id").alias("session_id")).join(given, "slug", "left_anti").select("session_id", "slug"))
        done = won if done is None else done.unionByName(won)
        given, left, n = given.unionByName(won.select("slug")), asked.join(won, "session_id", "left_anti").select("session_id"), n + 1
    return sessions.select("session_id").withColumn("slug", F.lit("")) if done is None else done
