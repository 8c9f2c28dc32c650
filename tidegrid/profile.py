"""What a deployment fixes: features, grid, window lengths and split sizes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Profile:
    features: tuple[str, ...]
    key: str = "cell"
    time: str = "ts"
    base_seconds: int = 10  # raw rows off this grid are dropped; 0 keeps all
    step_minutes: int = 5
    start_hour: int = 8
    end_hour: int = 21
    start: datetime = datetime(2018, 7, 2)
    end: datetime = datetime(2018, 8, 27)  # exclusive
    x_len: int = 10
    y_len: int = 1
    foresight: int = 0  # steps left out between x and y
    memory_days: int = 7
    low: float = -1.0
    high: float = 1.0
    test_days: int = 7
    dev_ratio: float = 0.1

    def __post_init__(self) -> None:
        if not self.features or len(set(self.features)) != len(self.features):
            raise ValueError("features must be distinct and at least one")
        if 60 % self.step_minutes and self.step_minutes % 60:
            raise ValueError("step_minutes must divide an hour or be whole hours")
        if not 0 <= self.start_hour < self.end_hour <= 24 or min(self.x_len, self.y_len, self.memory_days) < 1:
            raise ValueError("hours or lengths out of range")

    @property
    def slots_per_day(self) -> int:
        return (self.end_hour - self.start_hour) * 60 // self.step_minutes

    @property
    def m_len(self) -> int:
        """Steps that a memory day holds: those of x and y."""
        return self.x_len + self.y_len

    @property
    def span(self) -> int:
        """Consecutive rows from the first of x to the last of y."""
        return self.x_len + self.foresight + self.y_len


#: The network KPI deployment (fixed values: feature order, grid and window lengths).
KPI = Profile(("cqi", "rsrp", "rsrq", "dl_prb_usage_rate", "sinr", "ue_tx_power", "phr", "ue_conn_tot_cnt"))

#: Fixed online scaling ranges of the KPI deployment: feature, min, max.
KPI_RANGES = {
    "rsrp": (-121.0, 0.0),
    "rsrq": (-20.0, 0.0),
    "dl_prb_usage_rate": (1.0, 99.57666778564453),
    "sinr": (-3.676666736602783, 20.5),
    "ue_tx_power": (-10.943333625793457, 23.0),
    "phr": (0.5, 52.91666793823242),
    "ue_conn_tot_cnt": (0.0, 144.63333129882812),
    "cqi": (1.9620689153671265, 14.984615325927734),
}

#: The events table read as KPIs: one cell per event type, hourly, January 2024.
EVENTS = Profile(("value", "k"), base_seconds=0, step_minutes=60, start=datetime(2024, 1, 1), end=datetime(2024, 1, 31), x_len=5)
EVENT_CELLS = ("click", "error", "purchase", "signup", "view")
