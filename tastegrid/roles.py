"""Column roles: which column plays user, item, rating, time and title."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    user: str = "user_id"
    item: str = "item_id"
    rating: str = "rating"
    ts: str = "ts"
    title: str = "title"

    @property
    def key(self) -> list[str]:
        return [self.user, self.item]


REVIEW_ROLES = Roles("reviewerID", "asin", "rating", "unixReviewTime", "title")
MOVIE_ROLES = Roles("UserID", "MovieID", "Rating", "Timestamp", "Title")
