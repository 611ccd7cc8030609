"""The default term dictionary of the news classifier."""

from __future__ import annotations

# Category -> terms.
TERMS = {
    "tax": ["tax cuts", "tax increases", "tax rates", "taxes", "tax legislation", "income taxes"],
    "budget_debt": ["budget deficits", "federal budget", "deficit financing", "national debt",
                    "borrowing", "federal funding", "government debt"],
    "spending_social_programs": ["defense spending", "social security", "medicare", "stimulus",
                                 "federal spending"],
    "fiscal_policy": ["fiscal policy", "fiscal stimulus", "fiscal reform"],
    "tariffs_trade": ["tariffs", "trade policy", "trade disputes", "international trade",
                      "trade relations", "exports", "supply chains", "border security",
                      "immigration policy", "immigration", "deportation"],
    "america": ["america", "american", "alabama", "alaska", "arizona", "arkansas", "california",
                "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho",
                "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine",
                "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri",
                "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico",
                "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
                "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee",
                "texas", "utah", "vermont", "virginia", "washington", "west virginia",
                "wisconsin", "wyoming"],
}

COUNTRY_CATEGORY = "america"
TARIFF_CATEGORY = "tariffs_trade"
