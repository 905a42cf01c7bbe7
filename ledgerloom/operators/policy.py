"""Row-level visibility as one expression, applied before any limit or count; what cannot be read is denied."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.scores import first_that

STORED = ["public", "player", "reference", "narrator", "secret", "deny"]
#: From open to closed.
RANK = {level: i for i, level in enumerate(STORED)}


@dataclass(frozen=True)
class Viewer:
    workspaces: tuple[str, ...] = ()
    admin: bool = False
    sees_reference: bool = False
    sees_secret: bool = False
    max_session: int | None = None
    knows: tuple[str, ...] = field(default=())
    games: tuple[str, ...] = field(default=())
    character: str | None = None
    sees_lore: bool = False
    sees_future: bool = False


def reason(viewer: Viewer) -> Column:
    """Why a row (node_id, visibility, workspace, revealed_in) is shown or not; the first rule that applies decides."""
    level = F.lower(F.trim("visibility"))
    known = F.col("node_id").isin(*viewer.knows) if viewer.knows else F.lit(False)
    rules = [
        (level.isNull() | ~level.isin(STORED), "visibility_invalid"), (level == "deny", "deny_absolute"), (F.lit(viewer.admin), "admin_full"),
        (F.coalesce(F.trim("workspace"), F.lit("")) == "", "workspace_invalid"), (~F.col("workspace").isin(*viewer.workspaces or ("",)), "workspace_not_allowed"),
        (F.lit(viewer.max_session is None) & F.col("revealed_in").isNotNull(), "session_unknown"), (F.col("revealed_in") > F.lit(viewer.max_session), "not_revealed"),
        (known, "known"), (level.isin("secret", "narrator") & F.lit(not viewer.sees_secret), "secret_not_allowed"), ((level == "reference") & F.lit(not viewer.sees_reference), "reference_not_allowed"),
    ]
    return first_that(*rules, otherwise="level_allowed")


def scoped_reason(viewer: Viewer) -> Column:
    """Like reason(), for rows that also have scope (game or lore), game_id, known_from (a session) and known_by (characters).

    Nothing is shown by default: a row without a scope, of a game not the viewer's, of lore with a game, of a game without
    a first session, or of a later session than the viewer has reached is denied, whatever its level; who knows a row
    sees it whatever its level.
    """
    level, game = F.lower(F.trim("visibility")), F.coalesce(F.trim("game_id"), F.lit("")) != ""
    known = F.col("node_id").isin(*viewer.knows) if viewer.knows else F.lit(False)
    if viewer.character is not None:
        known = known | F.coalesce(F.array_contains("known_by", viewer.character), F.lit(False))
    in_game, since = F.col("scope") == "game", F.col("known_from")
    rules = [
        (level.isNull() | ~level.isin(STORED), "visibility_invalid"), (level == "deny", "deny_absolute"), (F.lit(viewer.admin), "visible"),
        (F.coalesce(F.trim("workspace"), F.lit("")) == "", "workspace_invalid"), (~F.col("workspace").isin(*viewer.workspaces or ("",)), "workspace_not_allowed"),
        (F.col("scope").isNull() | ~F.col("scope").isin("game", "lore"), "scope_invalid"), (in_game & ~game, "game_blank"), (in_game & ~F.col("game_id").isin(*viewer.games or ("",)), "game_not_allowed"),
        (~in_game & F.col("game_id").isNotNull(), "scope_contradiction"), (~in_game & F.lit(not viewer.sees_lore), "lore_not_allowed"), (F.col("known_by").isNull(), "known_by_invalid"),
        (~known & (level == "reference") & F.lit(not viewer.sees_reference), "reference_not_allowed"), (~known & (level == "secret") & F.lit(not viewer.sees_secret), "secret_not_allowed"),
        (~known & (level == "narrator") & F.lit(not viewer.sees_secret), "narrator_only"), (in_game & since.isNull(), "known_from_missing"), (since < 0, "known_from_invalid"),
    ]
    if not viewer.sees_future:
        rules.append((since.isNotNull() & F.lit(viewer.max_session is None), "session_cap_missing"))
        rules.append((since > F.lit(viewer.max_session), "future_session"))
    return first_that(*rules, otherwise="visible")


SHOWN = ["visible", "admin_full", "known", "level_allowed"]


def judged(rows: DataFrame, viewer: Viewer) -> DataFrame:
    return rows.withColumn("reason", reason(viewer)).withColumn("visible", F.col("reason").isin(SHOWN))


def most_restrictive(*levels: Column, fallback: str = "secret") -> Column:
    """The most closed of the levels; unreadable ones count as the fallback."""
    ranks = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    worst = F.greatest(*[F.coalesce(F.try_element_at(ranks, F.lower(x)), F.lit(RANK[fallback])) for x in levels])
    return F.get(F.array(*map(F.lit, STORED)), worst)
