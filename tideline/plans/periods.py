"""Civil periods and how far the data covers them. Runs on the driver; its bounds become literals of a plan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from tideline.functions.dates import ZONE

SELLER_ZONE = ZoneInfo(ZONE)
GOOD_RESULTS = ("ok", "sem_novos")
#: Covered share that both sides of a comparison need.
COMPARABLE = 0.7
MAX_DAYS = 730
MAX_ROLLING_DAYS = 365
DEFAULT_DAYS = 7


@dataclass(frozen=True)
class Period:
    start: date
    end: date

    @property
    def days(self) -> int:
        return (self.end - self.start).days + 1


@dataclass(frozen=True)
class Window:
    """What is known of a snapshot."""

    oldest: str | None
    newest: str | None
    partial: bool = False
    last_sync_at: str | None = None
    last_result: str | None = None


@dataclass(frozen=True)
class Coverage:
    kind: str  # total, parcial, indisponivel
    requested: Period
    covered: Period | None
    warnings: tuple[str, ...] = field(default=())

    @property
    def fraction(self) -> float:
        return self.covered.days / self.requested.days if self.covered else 0.0


class PeriodError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def parse_day(text: object) -> date | None:
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text, re.ASCII):
        return None
    try:
        return date.fromisoformat(text)
    except ValueError:
        return None


def parse_instant(text: object) -> datetime | None:
    """A strict ISO instant with an offset, as functions.dates.is_iso_instant tells it."""
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2})?(\.\d{1,3})?(Z|[+-]\d{2}:\d{2})", text, re.ASCII):
        return None
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        return None
    return found


def known_until(window: Window) -> datetime | None:
    """The newest order, or the last successful sync if that is later."""
    newest, sync = parse_instant(window.newest), parse_instant(window.last_sync_at)
    if sync and window.last_result in GOOD_RESULTS and (newest is None or sync > newest):
        return sync
    return newest


def coverage(period: Period, window: Window) -> Coverage:
    """The period clipped to what is known; a boundary day that isn't known whole makes it partial."""
    oldest, until = parse_instant(window.oldest), known_until(window)
    if oldest is None or until is None:
        return Coverage("indisponivel", period, None)
    oldest, until = oldest.astimezone(SELLER_ZONE), until.astimezone(SELLER_ZONE)
    first, last = oldest.date(), until.date()
    if period.end < first or period.start > last:
        return Coverage("indisponivel", period, None)
    clipped = Period(max(period.start, first), min(period.end, last))
    first_whole = (oldest.hour, oldest.minute, oldest.second, oldest.microsecond // 1000) == (0, 0, 0, 0)
    last_whole = (until.hour, until.minute, until.second, until.microsecond // 1000) >= (23, 59, 59, 999)
    at_start = clipped.start > period.start or clipped.start == first and not first_whole
    at_end = clipped.end < period.end or clipped.end == last and not last_whole
    warnings = [w for w, on in (("snapshot_parcial", window.partial), ("cobertura_parcial_inicio", at_start), ("cobertura_parcial_fim", at_end)) if on]
    return Coverage("parcial" if at_start or at_end else "total", period, clipped, tuple(warnings))


def comparable(a: Coverage, b: Coverage) -> bool:
    return a.covered is not None and b.covered is not None and min(a.fraction, b.fraction) >= COMPARABLE


def period_of_request(query: dict[str, object], today: date, default_days: int = DEFAULT_DAYS) -> Period:
    """The period of request parameters: dias, or from and to. The last n days reach back n days before today."""
    if set(query) - {"dias", "from", "to"}:
        raise PeriodError("parametro_desconhecido")
    if "dias" in query and ("from" in query or "to" in query):
        raise PeriodError("periodo_ambiguo")
    if "from" in query or "to" in query:
        if "from" not in query or "to" not in query:
            raise PeriodError("periodo_incompleto")
        start, end = parse_day(query["from"]), parse_day(query["to"])
        if start is None or end is None:
            raise PeriodError("data_invalida")
        if start > end:
            raise PeriodError("periodo_invertido")
        if (end - start).days > MAX_DAYS:
            raise PeriodError("periodo_longo")
        return Period(start, end)
    text = str(query.get("dias", default_days))
    if not re.fullmatch(r"\d{1,3}", text, re.ASCII) or not 1 <= int(text) <= MAX_DAYS:
        raise PeriodError("dias_invalido")
    return Period(today - timedelta(days=int(text)), today)


def civil_today(now: datetime) -> date:
    return now.astimezone(SELLER_ZONE).date()


def last_days(today: date, n: int) -> Period:
    """The n days up to and with today."""
    if not 1 <= n <= MAX_ROLLING_DAYS:
        raise PeriodError("janela_excessiva")
    return Period(today - timedelta(days=n - 1), today)


def month_of(year: int, month: int, today: date) -> Period:
    """A calendar month, as far as it has come."""
    first = date(year, month, 1)
    if first > today:
        raise PeriodError("data_inexistente")
    after = date(year + month // 12, month % 12 + 1, 1)
    return Period(first, min(after - timedelta(days=1), today))


def so_far_and_before(today: date, unit: str) -> tuple[Period, Period]:
    """The current week, month or year up to today, and as much of the one before."""
    if unit == "week":
        first = today - timedelta(days=today.weekday())
        before = first - timedelta(days=7)
        return Period(first, today), Period(before, before + (today - first))
    if unit == "month":
        first = today.replace(day=1)
        last = first - timedelta(days=1)
        return Period(first, today), Period(last.replace(day=1), last.replace(day=min(today.day, last.day)))
    first = date(today.year, 1, 1)
    leap = (today.month, today.day) == (2, 29)
    return Period(first, today), Period(date(today.year - 1, 1, 1), date(today.year - 1, today.month, 28 if leap else today.day))
