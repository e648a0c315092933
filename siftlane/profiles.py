"""The two capture profiles, as parameters.

A profile says which events count, how bodies are read and how many samples or
edges are kept.  Operators take ``profile="v1"``, ``profile="v2"`` or a
``CaptureProfile`` of the caller's own.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values (they define results and must stay as they are) ---------------------

# Hosts of trackers; a URL is flagged when its host contains one of these.
TRACKER_DOMAINS = (
    "google-analytics.com", "analytics.google.com", "googletagmanager.com", "doubleclick.net",
    "adtrafficquality.google", "googlesyndication.com", "criteo.com", "criteo.net", "openx.net",
    "crwdcntrl.net", "id5-sync.com", "facebook.net", "facebook.com", "segment.io", "hotjar.com",
    "sentry.io", "clarity.ms", "datadoghq.com", "branch.io", "appsflyer.com",
)

# Path endings of static files, profile v1.
STATIC_EXTENSIONS = (
    ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".woff", ".woff2", ".ttf",
    ".eot", ".mp3", ".mp4", ".map",
)

# Path endings of static files, profile v2.
MEDIA_EXTENSIONS = (".mp3", ".mp4", ".wav", ".avi", ".mov")

# Case-sensitive URL fragments of requests that are not logged, profile v2.
NOISE_FRAGMENTS = (
    "iadvize.com", "usejimo.com", "iconify.design", "privacy-center.org", "error-js",
    "utilisation-log", "events/log", "dynatrace", "google-analytics",
)

# --- End of fixed values --------------------------------------------------------------


@dataclass(frozen=True)
class CaptureProfile:
    """Parameters that differ between capture variants.  None switches a limit off."""

    name: str
    resource_types: tuple[str, ...]
    tracker_domains: tuple[str, ...]
    static_extensions: tuple[str, ...]
    noise_fragments: tuple[str, ...]
    drop_preflight: bool
    # Bodies are parsed only under a JSON content type (v1) or whenever present (v2).
    json_needs_content_type: bool
    # Bodies without a usable JSON value are kept as samples (v2) or not (v1).
    raw_text_samples: bool
    # What an empty path becomes in the endpoint key.
    empty_path: str
    sample_limit: int | None
    response_sample_limit: int | None
    edge_limit: int | None
    # The client table shows any first sample (v1) or only an object (v2).
    spec_needs_object: bool
    max_items: int | None = 10
    min_token: int | None = 3
    max_token: int | None = 120
    text_sample: int | None = 500


PROFILES = {
    "v1": CaptureProfile(
        name="v1",
        resource_types=("xhr", "fetch"),
        tracker_domains=TRACKER_DOMAINS,
        static_extensions=STATIC_EXTENSIONS,
        noise_fragments=(),
        drop_preflight=False,
        json_needs_content_type=True,
        raw_text_samples=False,
        empty_path="",
        sample_limit=5,
        response_sample_limit=0,
        edge_limit=100,
        spec_needs_object=False,
    ),
    "v2": CaptureProfile(
        name="v2",
        resource_types=("xhr", "fetch", "document"),
        tracker_domains=(),
        static_extensions=MEDIA_EXTENSIONS,
        noise_fragments=NOISE_FRAGMENTS,
        drop_preflight=True,
        json_needs_content_type=False,
        raw_text_samples=True,
        empty_path="/",
        sample_limit=2,
        response_sample_limit=2,
        edge_limit=None,
        spec_needs_object=True,
    ),
}


def profile_of(profile: str | CaptureProfile) -> CaptureProfile:
    """Look a profile up by name; pass a ``CaptureProfile`` through."""
    return profile if isinstance(profile, CaptureProfile) else PROFILES[profile]
