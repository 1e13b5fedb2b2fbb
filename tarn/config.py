"""Every limit of the engine, by name (M3)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Defaults are choices of this engine; pass another ``Config`` to change them."""

    text_limit: int = 10_000  # characters of a text that are tokenized
    term_limit: int = 32  # longest term in characters
    shape_limit: int = 512  # longest DOM shape in characters
    domain_cap: int = 5  # results of one domain
    postings_limit: int = 10  # postings of one term
    postings_per_domain: int = 2  # postings of one domain in one term
    compact_over: float = 1.1  # times the limit at which a term's postings are cut
    compact_percent: int = 2  # chance, in percent, of a cut below that
    frontier_size: int = 100  # URLs that a crawl level keeps
    frontier_per_domain: int = 3
    frontier_http: int = 50
    frontier_orphans: int = 50
    crawl_depth: int = 4
    bloom_words: int = 1 << 16  # words of 64 bits of the filter of visited URLs
    prosperous: int = 3  # backlinking domains that make a URL prosperous
    snippet: int = 80  # characters around the first hit
    results: int = 10  # results of a search
    word_longest: int = 8  # letters of a learnt word
    word_least: int = 5  # times that it occurs
    word_cohesion: float = 0.0  # how much its parts stick together
    word_entropy: float = 2.2  # how much what stands beside it varies
    word_passes: int = 2  # times that words are counted again by the cut of the texts
    dictionary: int = 200_000  # words that tasks cut by
    index_buckets: int = 16  # folders of a stored index's segment
    index_segments: int = 4  # segments of a bucket before they are made one
    block_cell: int = 256  # document numbers that a block's documents lie within
    block_size: int = 128  # postings of a block
    seed_cells: int = 32  # cells that are read before the others, for a floor of the scores


DEFAULT = Config()
