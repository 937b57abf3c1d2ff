"""Typed failures. Every class is also the builtin exception a Python caller would expect."""


class TraceError(Exception):
    """Root of all typed failures."""

    template = "{0}"

    def __init__(self, *args):
        self.details = args
        super().__init__(self.template.format(*args))

    def __str__(self):
        return self.template.format(*self.details)

    def __reduce__(self):
        return type(self), self.details


class FileOpenError(TraceError, OSError):
    template = "failed to open file: {0}"


class MapFailedError(TraceError, OSError):
    template = "failed to create memory map: {0}"


class FileTooSmall(TraceError, ValueError):
    template = "file too small: expected at least {0} bytes, got {1}"


class InvalidHeaderField(TraceError, ValueError):
    template = "invalid header field `{0}`: {1}"


class HeaderSizeMismatch(TraceError, ValueError):
    template = "header declares {0} header bytes, but file is only {1} bytes"


class NoSignals(TraceError, ValueError):
    template = "signal count is zero"


class InvalidSignalField(TraceError, ValueError):
    template = "signal {0} has invalid `{1}`: {2}"


class InvalidDigitalRange(TraceError, ValueError):
    template = "signal {0} has digital_min ({1}) >= digital_max ({2})"


class InvalidPhysicalRange(TraceError, ValueError):
    template = "signal {0} has physical_min ({1}) == physical_max ({2})"


class RecordOutOfRange(TraceError, IndexError):
    template = "record index {0} out of range (file has {1} records)"


class SignalOutOfRange(TraceError, IndexError):
    template = "signal index {0} out of range (file has {1} signals)"


class SampleOutOfRange(TraceError, IndexError):
    template = "sample index {0} out of range (signal has {1} samples)"


class SignalNotFound(TraceError, KeyError):
    template = "no signal with label `{0}`"


class MixedSampleRates(TraceError, ValueError):
    template = "mixed sample rates: {0}"
