"""Names, vocabularies and thresholds that results depend on."""

# Columns of the score table before and after the tag scores.
PROBLEM_COLUMNS = [
    "no", "source", "id", "title", "rating", "difficulty", "official_tags",
    "time_limit_ms", "memory_limit_mb", "testcase_count", "checker_status",
    "selected_language", "selected_submission_index", "description", "source_url",
]
SOLUTION_COLUMNS = [
    "solution_column", "solution_index", "is_selected_solution", "solution_valid",
    "solution_language", "solution_length", "solution_summary",
]
SUMMARY_COLUMNS = [
    "primary_algorithm", "primary_score", "secondary_algorithms", "is_composite",
    "composite_algorithm", "top_3_algorithms", "code_evidence", "time_complexity_reasoning",
    "classification_reason", "rejected_candidates", "confidence", "uncertain_points",
    "compared_with_other_solutions",
]

# The 120 distinct scored tags, in order. Two of them, HEAP_GREEDY and
# BITMASK_DP, belong to two sections; the table holds each once.
SCORE_TAGS = [
    "IMPLEMENTATION", "SIMULATION", "GRID_SIMULATION", "EVENT_SIMULATION", "STATE_SIMULATION",
    "BRUTE_FORCE", "BACKTRACKING", "PERMUTATION_SEARCH", "COMBINATION_SEARCH", "BRANCH_AND_BOUND",
    "SORTING", "CUSTOM_SORTING", "COUNTING_SORT",
    "BINARY_SEARCH", "PARAMETRIC_SEARCH", "BOUND_SEARCH",
    "TWO_POINTERS", "SLIDING_WINDOW", "FIXED_WINDOW", "VARIABLE_WINDOW",
    "PREFIX_SUM", "PREFIX_SUM_2D", "DIFFERENCE_ARRAY", "IMOS",
    "HASH", "HASH_MAP", "HASH_SET", "STRING_HASHING",
    "STACK", "MONOTONIC_STACK", "QUEUE", "DEQUE", "MONOTONIC_QUEUE",
    "HEAP", "PRIORITY_QUEUE", "HEAP_GREEDY",
    "BFS", "DFS", "GRAPH_TRAVERSAL", "GRID_TRAVERSAL", "FLOOD_FILL", "CONNECTED_COMPONENTS",
    "MULTI_SOURCE_BFS", "STATE_SPACE_SEARCH",
    "DIJKSTRA", "BELLMAN_FORD", "FLOYD_WARSHALL", "ZERO_ONE_BFS", "SHORTEST_PATH_DAG",
    "UNION_FIND", "MST", "KRUSKAL", "PRIM",
    "TOPO_SORT", "TOPO_SORT_DP",
    "DP", "DP_1D", "DP_2D", "GRID_DP", "KNAPSACK_DP", "INTERVAL_DP", "BITMASK_DP", "TREE_DP",
    "DP_ON_DAG", "DIGIT_DP", "LIS", "LCS", "EDIT_DISTANCE",
    "GREEDY", "SORTING_GREEDY", "INTERVAL_GREEDY",
    "TREE", "TREE_TRAVERSAL", "LCA", "EULER_TOUR", "TREE_DIAMETER", "SUBTREE_QUERY",
    "SEGMENT_TREE", "LAZY_SEGMENT_TREE", "FENWICK_TREE", "RANGE_SUM_QUERY", "RANGE_MIN_QUERY",
    "COORD_COMP_SEGMENT", "DYNAMIC_SEGMENT_TREE",
    "TRIE", "BINARY_TRIE",
    "STRING", "KMP", "PALINDROME", "MANACHER", "AHO_CORASICK",
    "MATH", "NUMBER_THEORY", "GCD_LCM", "PRIME_CHECK", "SIEVE", "MODULAR_ARITHMETIC",
    "FAST_POWER", "MODULAR_INVERSE", "COMBINATORICS", "INCLUSION_EXCLUSION",
    "PROBABILITY", "EXPECTED_VALUE", "GAME_THEORY",
    "GEOMETRY", "CCW", "LINE_SEGMENT_INTERSECTION", "CONVEX_HULL", "POLYGON_AREA",
    "BITMASK", "BITMASK_BRUTE_FORCE", "BIT_MANIPULATION", "SUBSET_ENUMERATION",
    "DIVIDE_AND_CONQUER", "SWEEP_LINE", "COORDINATE_COMPRESSION", "OFFLINE_QUERY",
    "MEET_IN_THE_MIDDLE", "SPARSE_TABLE",
    "UNKNOWN",
]

# Broad tags and the candidates each is rechecked against, in order.
BROAD_CANDIDATES = {
    "GREEDY": ["SORTING", "PRIORITY_QUEUE", "SEGMENT_TREE", "FENWICK_TREE", "UNION_FIND",
               "BINARY_SEARCH", "PARAMETRIC_SEARCH", "TWO_POINTERS", "STACK", "DP", "GRAPH"],
    "DP": ["PREFIX_SUM", "BFS", "DFS", "DIJKSTRA", "SEGMENT_TREE", "FENWICK_TREE",
           "BINARY_SEARCH", "GREEDY", "TOPO_SORT", "TREE", "BITMASK"],
    "BITMASK": ["BRUTE_FORCE", "BACKTRACKING", "DP", "BFS", "DFS", "SIMULATION", "MATH"],
    "MATH": ["GCD_LCM", "SIEVE", "COMBINATORICS", "MODULAR_ARITHMETIC", "BINARY_SEARCH",
             "PARAMETRIC_SEARCH", "GEOMETRY", "GREEDY", "DP", "BRUTE_FORCE"],
}

# Vocabulary of the one-hot flag tables.
FLAG_TAGS = [
    "BFS", "Backtracking", "Binary Search", "Bitmasking", "Brute Force", "DFS", "Dijkstra",
    "Dynamic Programming", "Floyd-Warshall", "Greedy", "Hash Table", "Heap", "Implementation",
    "KMP", "Kruskal", "LCA", "Linked List", "Parametric Search", "Prim", "Priority Queue",
    "Segment Tree", "Sliding Window", "Topological Sort", "Trie", "Two Pointers", "Union-Find",
]

# Closed lists and thresholds.
DECISIONS = ["KEEP_ORIGINAL", "REVIEW_NEEDED", "LIKELY_SPECIFIC_ALGORITHM"]
CONFIDENCE_LEVELS = ["HIGH", "MEDIUM", "LOW"]
RECHECK_SCORE = 60
FULL_MATCH = 0.999
NO_MATCH = 0.001
NO_COMPARISON_MARKER = "비교 불가"

# Columns of the split corpus, front ones first.
PROBLEM_FRONT_COLUMNS = [
    "id", "question", "count_cases", "count_solutions", "difficulty", "raw_tags", "tags",
    "skill_types", "time_limit", "memory_limit", "Expected Time Complexity",
    "Expected Auxiliary Space",
]

# Language rules, first match wins.
LANGUAGE_RULES = [
    ("C++", ["#include", "using namespace std"]),
    ("Java", ["public class", "import java"]),
    ("Python", ["def ", "import sys", "print("]),
]


def recheck_tags(broad: dict[str, list[str]] = BROAD_CANDIDATES) -> list[str]:
    """All candidates of the broad tags, each once, by name."""
    return sorted({tag for tags in broad.values() for tag in tags})


def score_columns(tags: list[str] = SCORE_TAGS) -> list[str]:
    return ["problem_solution_key", *PROBLEM_COLUMNS, *SOLUTION_COLUMNS, *tags, *SUMMARY_COLUMNS]


def recheck_columns(broad: dict[str, list[str]] = BROAD_CANDIDATES) -> list[str]:
    return [
        "problem_solution_key", "id", "title", "solution_column", "solution_index",
        "source_broad_tag", "source_broad_score", *recheck_tags(broad),
        "recheck_best_candidate", "recheck_best_score", "recheck_decision", "recheck_reason",
    ]
