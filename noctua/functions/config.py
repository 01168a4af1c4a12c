"""Settings of a job and the fixed labels."""

from __future__ import annotations

from dataclasses import dataclass

# Labels of usability, mobility and sleep stages, and error codes.
GOOD, NO_DATA, HIGH, SPIKY, M_SHAPED = 0, 1, 2, 3, 4
IDLE, LAYING, STATIONARY, MOBILE = 0, 1, 2, 3
WAKE, N1, N2, N3, REM, REM_ALTERNATIVE, PLACEHOLDER = 0, 1, 2, 3, 4, 5, 9
ERRORS = {
    1: "the signal files cannot be read",
    2: "the recording is shorter than a minute",
    3: "more than one combined file",
    4: "the sleep scores cannot be read",
    5: "the sleep scores do not fit the recording's duration",
    6: "a sleep score is outside 0 to 5",
    7: "the sleep scores do not fit the usability scores",
    8: "reserved",
    9: "no lights-out or lights-on moment",
    10: "no scores for sleep statistics",
    11: "the time in bed is a minute or less",
    12: "acceleration outside -2 to 2 g",
    13: "a required channel is missing",
}
#: Codes that do not stop a night.
NOT_FATAL = (9, 10, 11)


@dataclass(frozen=True)
class Config:
    usability_len: int = 10
    mobility_len: int = 10
    sleep_len: int = 30
    rate: int = 256
    unusable: int = -1
    least_minutes_laying: int = 2

    def __post_init__(self):
        if self.sleep_len % self.usability_len or self.sleep_len % self.mobility_len:
            raise ValueError("a sleep epoch must be a whole number of usability and of mobility epochs")
        if self.least_minutes_laying < 1:
            raise ValueError("a run of laying must be required")

    @property
    def per_sleep(self) -> int:
        """Usability epochs of a sleep epoch."""
        return self.sleep_len // self.usability_len

    @property
    def mobility_per_sleep(self) -> int:
        return self.sleep_len // self.mobility_len

    @property
    def least_run(self) -> int:
        """Mobility epochs of a run that counts as lying in bed."""
        return self.least_minutes_laying * 60 // self.mobility_len
