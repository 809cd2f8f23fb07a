"""Properties against brute force on random small frames: the window of each
hit (open at both ends, millisecond grain), per-level counts, and the
invariant requests = sum over urls = sum over ips = sum over agents."""

import collections
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st_

from hitlens.functions.windows import StatDefinition
from hitlens.operators import stats as st

from .conftest import hits_frame

BASE = dt.datetime(2024, 1, 1)
EPOCH = dt.datetime(1970, 1, 1)

hit = st_.tuples(
    st_.sampled_from(["s1", "s2", "s3"]),
    # offsets in µs; many land on whole milliseconds and on window boundaries
    st_.one_of(st_.integers(0, 3_600_000_000),
               st_.integers(0, 12).map(lambda k: k * 300_000_000),
               st_.integers(0, 12).map(lambda k: k * 300_000_000 + 999)),
    st_.sampled_from(["/a", "/b"]), st_.sampled_from(["1", "2", "3"]), st_.sampled_from(["x", "y"]))


def brute_force(rows, range_ms):
    """Window end of each hit by the reference's rule, or None."""
    out = []
    for site, off, url, ip, ua in rows:
        t = BASE + dt.timedelta(microseconds=off)
        ms = (t - EPOCH) // dt.timedelta(milliseconds=1)
        if ms % range_ms == 0:
            out.append(None)  # the boundary millisecond belongs to no window
            continue
        end_ms = (ms // range_ms + 1) * range_ms
        out.append(EPOCH + dt.timedelta(milliseconds=end_ms))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st_.lists(hit, min_size=1, max_size=40), minutes=st_.sampled_from([5, 60]))
def test_levels_match_brute_force(spark, rows, minutes):
    stat = StatDefinition(f"{minutes}_minutes", minutes * 60_000)
    frame = hits_frame(spark, [(s, BASE + dt.timedelta(microseconds=o), u, i, a)
                               for s, o, u, i, a in rows])
    ends = brute_force(rows, stat.range_ms)
    expected = collections.Counter()
    for (site, _, url, ip, ua), end in zip(rows, ends):
        if end is None:
            continue
        expected[("site", site, end, None)] += 1
        expected[("url", site, end, url)] += 1
        expected[("ip", site, end, ip)] += 1
        expected[("browser", site, end, ua)] += 1
    got = collections.Counter({(r.level, r.site_id, r.stat_time, r.key): r.requests
                               for r in st.stats_all_levels(frame, stat).collect()})
    assert got == expected
    for level in ("url", "ip", "browser"):
        per_level = sum(v for k, v in got.items() if k[0] == level)
        assert per_level == sum(v for k, v in got.items() if k[0] == "site")
    ledger = st.stats_reference(frame, stat)
    assert sum(r.affected_records for r in ledger.collect()) == sum(e is not None for e in ends)
