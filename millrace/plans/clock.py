"""Time windows: half-open, in whole periods, resolved against a given now."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from ..errors import SemanticError

GRAINS = ("day", "week", "month", "quarter", "year")
#: Rows of a dense series that a window of one unit spans, by the series' grain.
ROWS = {("day", "day"): 1, ("day", "week"): 7, ("week", "week"): 1, ("month", "month"): 1, ("month", "quarter"): 3, ("month", "year"): 12, ("quarter", "quarter"): 1, ("quarter", "year"): 4, ("year", "year"): 1}


#: Grains that periods of a grain add up to.
COARSER = {"day": GRAINS, "week": ("week",), "month": ("month", "quarter", "year"), "quarter": ("quarter", "year"), "year": ("year",)}


def trunc(d: date, unit: str) -> date:
    if unit == "week":
        return d - timedelta(days=d.weekday())
    month = {"month": d.month, "quarter": d.month - (d.month - 1) % 3, "year": 1}.get(unit)
    return d if month is None else date(d.year, month, 1)


def shift(d: date, unit: str, n: int) -> date:
    if unit in ("day", "week"):
        return d + timedelta(days=n * (7 if unit == "week" else 1))
    months = d.year * 12 + d.month - 1 + n * {"month": 1, "quarter": 3, "year": 12}[unit]
    return date(months // 12, months % 12 + 1, 1)


KEYS = {"grain", "clock", "now", "last", "this", "start", "end", "fill"}


def check(time: dict) -> None:
    """Refuses keys and shapes that a call's time doesn't have, so that a misspelt bound isn't read as no bound."""
    if unknown := set(time) - KEYS:
        raise SemanticError("INVALID_QUERY", f"unknown keys {sorted(unknown)} of time", allowed=sorted(KEYS))
    if sum(k in time for k in ("last", "this")) + bool({"start", "end"} & set(time)) > 1:
        raise SemanticError("INVALID_QUERY", "state one of last, this, and start with end")
    if "last" in time and (not isinstance(time["last"], dict) or set(time["last"]) != {"unit", "value"} or time["last"]["unit"] not in GRAINS or not isinstance(time["last"]["value"], int) or time["last"]["value"] < 1):
        raise SemanticError("INVALID_QUERY", "last needs a unit and a value of at least 1")
    if "this" in time and time["this"] not in GRAINS:
        raise SemanticError("INVALID_QUERY", f"no period {time['this']}")
    for k in ("now", "start", "end"):
        try:
            if time.get(k) is not None:
                datetime.fromisoformat(time[k])
        except (TypeError, ValueError) as e:
            raise SemanticError("INVALID_QUERY", f"{k} must be an ISO date or time") from e


def window(time: dict) -> tuple[date | datetime | None, date | datetime | None, bool]:
    """(start, end, named): `last` n complete periods, `this` period up to now, or start/end; a named window has every period.

    now may be a day (its beginning) or an instant. A window that states only its start ends at now, where now is given.
    """
    check(time)
    instant = datetime.fromisoformat(time["now"]).replace(tzinfo=None) if time.get("now") else None
    if ("last" in time or "this" in time) and instant is None:
        raise SemanticError("INVALID_QUERY", "a relative window needs now")
    now = instant and (instant.date() if instant == datetime(instant.year, instant.month, instant.day) else instant)
    if "last" in time:
        unit, n = time["last"]["unit"], time["last"]["value"]
        end = trunc(instant.date(), unit)
        return shift(end, unit, -n), end, True
    if "this" in time:
        return trunc(instant.date(), time["this"]), now, True
    start, end = (_bound(time[k]) if time.get(k) else None for k in ("start", "end"))
    if start and not end and now:
        return start, now, False
    if start and end and datetime.fromisoformat(start.isoformat()) > datetime.fromisoformat(end.isoformat()):
        raise SemanticError("INVALID_QUERY", "the window ends before it starts")
    return start, end, start is not None and end is not None


def _bound(text: str) -> date | datetime:
    at = datetime.fromisoformat(text).replace(tzinfo=None)
    return at.date() if at == datetime(at.year, at.month, at.day) else at


def whole(d: date | datetime | None, grain: str) -> bool:
    """Whether a bound falls between two periods."""
    return d is None or not isinstance(d, datetime) and trunc(d, grain) == d


def rows(grain: str, unit: str, n: int) -> int:
    if (grain, unit) not in ROWS:
        raise SemanticError("REWRITE_NOT_SUPPORTED", f"a window of {unit}s on a series by {grain}")
    return n * ROWS[grain, unit]
