"""The one filter that every incident query goes through, and its parameter checks."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 500


@dataclass(frozen=True)
class Box:
    """A viewport in degrees; edges belong to it.

    Planar edges follow parallels.  With geodesic the upper and lower edges are
    great-circle arcs between the corners, as on a globe: they bow towards the nearer pole,
    by some 30 m over half a degree at 42 degrees north.  Sides are meridians either way.
    """

    west: float
    south: float
    east: float
    north: float
    geodesic: bool = False

    def __post_init__(self) -> None:
        if not (-180 <= self.west < self.east <= 180 and -90 <= self.south < self.north <= 90):
            raise ValueError(f"not a box of degrees: {self}")
        if self.geodesic and self.east - self.west >= 180:
            raise ValueError("a geodesic box is narrower than half the globe")

    def _arc(self, edge: float, lon: Column) -> Column:
        """The latitude of the arc between the corners of an edge, at a longitude."""
        if abs(edge) == 90:
            return F.lit(float(edge))
        half = math.radians(self.east - self.west) / 2
        away = F.radians(lon - F.lit((self.west + self.east) / 2))
        return F.degrees(F.atan(F.cos(away) * F.lit(math.tan(math.radians(edge)) / math.cos(half))))

    def reach(self) -> tuple[float, float]:
        """The parallels that the box lies between."""
        if not self.geodesic:
            return self.south, self.north
        half = math.radians(self.east - self.west) / 2
        top = lambda edge: math.degrees(math.atan(math.tan(math.radians(edge)) / math.cos(half)))
        return min(self.south, top(self.south)), max(self.north, top(self.north))

    def holds(self, lon: Column, lat: Column) -> Column:
        """Null coordinates are in no box.  The plain bounds stand alone, for the scan."""
        low, high = self.reach()
        within = lon.between(self.west, self.east) & lat.between(low, high)
        if self.geodesic:
            within &= (lat >= self._arc(self.south, lon)) & (lat <= self._arc(self.north, lon))
        return within

    @classmethod
    def of(cls, west=None, south=None, east=None, north=None) -> Box | None:
        """A box from four optional parameters: all of them or none."""
        given = [x is not None for x in (west, south, east, north)]
        if not any(given):
            return None
        if not all(given):
            raise ValueError("a box needs west, south, east and north")
        return cls(west, south, east, north)


@dataclass(frozen=True)
class Filters:
    """What a caller may ask for; None leaves a criterion out.

    end is a whole calendar day, so the rows of that day belong to the range.
    """

    source_id: str | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    category: str | None = None
    neighborhood: str | None = None
    district: str | None = None
    box: Box | None = None


def moment(df: DataFrame, day: dt.date, name: str = "occurred_at") -> Column:
    """The start of day as a literal of the column's own type, so that it is pushed down."""
    return F.lit(day.isoformat()).cast(df.schema[name].dataType)


def in_days(df: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """Rows from the start of day start up to the end of day end."""
    if start is not None:
        df = df.where(F.col("occurred_at") >= moment(df, start))
    if end is not None:
        df = df.where(F.col("occurred_at") < moment(df, end + dt.timedelta(days=1)))
    return df


def filter_incidents(incidents: DataFrame, offenses: DataFrame, by: Filters) -> DataFrame:
    """Incidents that meet every given criterion, each once.

    A category is met by any offense of the incident: a left semi join, which
    never multiplies incidents.
    """
    found = in_days(incidents, by.start, by.end)
    for name in ("source_id", "neighborhood", "district"):
        value = getattr(by, name)
        if value is not None:
            found = found.where(F.col(name) == F.lit(value))
    if by.box is not None:
        found = found.where(by.box.holds(F.col("lon"), F.col("lat")))
    if by.category is not None:
        chosen = offenses.where(F.col("source_category") == F.lit(by.category))
        found = found.join(
            chosen.select(F.col("incident_id").alias("id")), "id", "left_semi"
        )
    return found


def checked_page(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return limit, offset


def checked_range(
    start: dt.date | None,
    end: dt.date | None,
    first: dt.date | None = None,
    last: dt.date | None = None,
) -> None:
    """Strict mode of date ranges: in order, and inside what the data covers."""
    if start and end and start > end:
        raise ValueError("the range ends before it starts")
    for day in (start, end):
        if day and ((first and day < first) or (last and day > last)):
            raise ValueError(f"{day} is outside the data's {first} to {last}")
