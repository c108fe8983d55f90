"""World coordinates, colour temperature and window coefficients, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import cos, pi, radians, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from nebulark.functions.validity import col

#: Planck's constant, the speed of light, Boltzmann's constant; wavelengths of red, green and blue in nm.
H, C, K = 6.626e-34, 2.998e8, 1.381e-23
RGB_NM = (640.0, 530.0, 460.0)

#: Upper colour index of a piece, temperature at that end, kelvin a unit below it.
TEMPERATURE = ((0.0, 10000.0, 20000.0), (0.5, 7500.0, 5000.0), (1.0, 5800.0, 3400.0), (1.5, 4500.0, 2600.0), (2.5, 3500.0, 1000.0), (5.0, 2800.0, 280.0))


@dataclass(frozen=True)
class Wcs:
    """A linear transform from pixels (0-based) to a tangent plane, and its projection."""

    crpix: tuple[float, float]
    crval: tuple[float, float]
    cd: tuple[float, float, float, float]
    projection: str = "TAN"

    @classmethod
    def from_header(cls, header: dict[str, str]) -> Wcs:
        """From header cards: a CD matrix, or else CDELT and CROTA2; an unknown projection counts as TAN."""

        def number(key: str) -> float | None:
            try:
                return float(header[key].strip())
            except (KeyError, ValueError):
                return None

        points = [number(k) for k in ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2")]
        if None in points:
            raise ValueError("CRPIX or CRVAL is missing")
        cd = tuple(number(k) for k in ("CD1_1", "CD1_2", "CD2_1", "CD2_2"))
        if None in cd:
            dx, dy, turn = number("CDELT1"), number("CDELT2"), radians(number("CROTA2") or 0.0)
            if dx is None or dy is None:
                raise ValueError("CD and CDELT are missing")
            cd = (dx * cos(turn), -dy * sin(turn), dx * sin(turn), dy * cos(turn))
        kind = header.get("CTYPE1", "").strip().rpartition("-")[2]
        return cls(tuple(points[:2]), tuple(points[2:]), cd, kind if kind in ("TAN", "SIN", "ARC", "CAR") else "TAN")

    def to_world(self, x: Column | str, y: Column | str) -> tuple[Column, Column]:
        """Right ascension, in 0 to 360, and declination of a pixel, in degrees."""
        dx, dy = col(x) + 1 - self.crpix[0], col(y) + 1 - self.crpix[1]
        a, b, c, d = self.cd
        xi, eta = F.radians(a * dx + b * dy), F.radians(c * dx + d * dy)
        ra0, dec0 = map(radians, self.crval)
        s0, c0 = sin(dec0), cos(dec0)
        if self.projection == "CAR":
            ra, dec = ra0 + xi / c0, dec0 + eta
        elif self.projection == "TAN":
            far = c0 - eta * s0
            ra, dec = ra0 + F.atan2(xi, far), F.atan2(s0 + eta * c0, F.sqrt(xi * xi + far * far))
        else:
            rho = F.sqrt(xi * xi + eta * eta)
            if self.projection == "SIN":
                near, out = F.sqrt(F.greatest(F.lit(0.0), 1 - rho * rho)), F.lit(1.0)
            else:  # ARC: the distance is the angle
                near, out = F.cos(rho), F.when(rho < 1e-15, 1.0).otherwise(F.try_divide(F.sin(rho), rho))
            ra, dec = ra0 + F.atan2(xi * out, near * c0 - eta * out * s0), F.asin(near * s0 + eta * out * c0)
        return F.pmod(F.degrees(ra), F.lit(360.0)), F.degrees(dec)

    def to_pixel(self, ra: Column | str, dec: Column | str) -> tuple[Column, Column]:
        """The pixel of a direction; NaN where it has none."""
        a, b, c, d = self.cd
        det, nan = a * d - b * c, F.lit(float("nan"))
        if abs(det) < 1e-30:
            return nan, nan
        ra0, dec0 = map(radians, self.crval)
        s0, c0 = sin(dec0), cos(dec0)
        turn, dec = F.radians(col(ra)) - ra0, F.radians(col(dec))
        if self.projection == "CAR":
            xi, eta = turn * c0, dec - dec0
        else:
            near = F.sin(dec) * s0 + F.cos(dec) * c0 * F.cos(turn)
            east, north = F.cos(dec) * F.sin(turn), F.sin(dec) * c0 - F.cos(dec) * s0 * F.cos(turn)
            if self.projection == "TAN":
                out = F.when(F.abs(near) < 1e-15, nan).otherwise(F.try_divide(F.lit(1.0), near))
            elif self.projection == "SIN":
                out = F.lit(1.0)
            else:
                angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), near)))
                out = F.when(F.abs(angle) < 1e-15, 0.0).otherwise(F.try_divide(angle, F.sin(angle)))
            xi, eta = east * out, north * out
        xi, eta = F.degrees(xi), F.degrees(eta)
        return (d * xi - b * eta) / det + self.crpix[0] - 1, (a * eta - c * xi) / det + self.crpix[1] - 1

    def pixel_scale(self) -> float:
        """Arc seconds."""
        a, b, c, d = self.cd
        return (sqrt(a * a + c * c) + sqrt(b * b + d * d)) / 2 * 3600

    def field_of_view(self, width: int, height: int) -> tuple[float, float]:
        """Arc minutes."""
        a, b, c, d = self.cd
        return width * sqrt(a * a + c * c) * 60, height * sqrt(b * b + d * d) * 60

    def resampled(self, sx: float, sy: float) -> Wcs:
        """After an image shrank by factors sx and sy."""
        a, b, c, d = self.cd
        return Wcs(((self.crpix[0] - 0.5) / sx + 0.5, (self.crpix[1] - 0.5) / sy + 0.5), self.crval, (a * sx, b * sy, c * sx, d * sy), self.projection)

    def shifted(self, dx: float, dy: float) -> Wcs:
        return Wcs((self.crpix[0] - dx, self.crpix[1] - dy), self.crval, self.cd, self.projection)


def sexagesimal(ra: Column | str, dec: Column | str) -> tuple[Column, Column]:
    """Hours, minutes and seconds; signed degrees, minutes and seconds."""
    hours, dec = col(ra) / 15, col(dec)
    h = F.floor(hours)
    m = F.floor((hours - h) * 60)
    s = ((hours - h) * 60 - m) * 60
    size = F.abs(dec)
    d = F.floor(size)
    dm = F.floor((size - d) * 60)
    ds = ((size - d) * 60 - dm) * 60
    return F.format_string("%02dh %02dm %05.2fs", h, m, s), F.format_string("%s%02d° %02d' %04.1f\"", F.when(dec < 0, "-").otherwise("+"), d, dm, ds)


def color_temperature(index: Column | str) -> Column:
    """Kelvin of a colour index, clamped to -0.5 to 5."""
    x = F.greatest(F.lit(-0.5), F.least(F.lit(5.0), col(index)))
    out = None
    for top, kelvin, slope in TEMPERATURE:
        piece = kelvin + (top - x) * slope
        out = F.when(x < top, piece) if out is None else out.when(x < top, piece)
    return out.otherwise(TEMPERATURE[-1][1] + (TEMPERATURE[-1][0] - x) * TEMPERATURE[-1][2])


def planck(kelvin: Column | str, nm: float) -> Column:
    wave = nm * 1e-9
    power = H * C / (wave * K) / col(kelvin)
    return F.when(power > 500, 0.0).otherwise(2 * H * C * C / wave**5 / (F.exp(F.least(power, F.lit(500.0))) - 1))


def planck_rgb(kelvin: Column | str) -> tuple[Column, Column, Column]:
    """Relative to the largest of the three."""
    parts = [planck(kelvin, nm) for nm in RGB_NM]
    most = F.greatest(*parts)
    return tuple(F.when(most < 1e-30, 1.0).otherwise(F.try_divide(p, most)) for p in parts)


def lanczos3(x: Column | str) -> Column:
    x = col(x)
    sinc = lambda t: F.when(F.abs(t) < 1e-12, 1.0).otherwise(F.try_divide(F.sin(t * pi), t * pi))
    return F.when(F.abs(x) >= 3, 0.0).otherwise(sinc(x) * sinc(x / 3))


def hann(i: Column | str, n: int, periodic: bool = True) -> Column:
    return 0.5 * (1 - F.cos(2 * pi * col(i) / (n if periodic else max(n - 1, 1))))


def tukey(i: Column | str, n: int, alpha: float = 0.5) -> Column:
    if alpha <= 0 or n < 2:
        return F.lit(1.0)
    x = col(i) / (n - 1)
    edge = F.least(x, 1 - x)
    return F.when(edge < alpha / 2, 0.5 * (1 - F.cos(2 * pi * edge / alpha))).otherwise(1.0)


def cosine_bell(i: Column | str, n: int) -> Column:
    return F.sin(pi * col(i) / max(n - 1, 1))

