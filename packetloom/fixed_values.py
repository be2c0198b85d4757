"""Names, labels and constants that results must agree on.

Everything in this module is data. It is stated plainly and in natural order
because scores, keys and display rows are only comparable when it matches.
"""

# TCP flag bits.
FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32

BENIGN = "BENIGN"
UNKNOWN = "UNKNOWN"

# Attack families in their customary order.
ATTACK_FAMILIES = (
    "PORT_SCAN", "NET_SCAN", "DOS_FLOOD", "SSH_BRUTEFORCE", "WEB_BRUTEFORCE",
    "SLOWLORIS", "DNS_TUNNEL", "EXFILTRATION", "C2_BEACON",
)

# Families grouped on the victim and on the source.
VICTIM_FAMILIES = ("DOS_FLOOD", "SLOWLORIS")
SOURCE_FAMILIES = ("PORT_SCAN", "NET_SCAN")

# Fixed values: (family, display title, ATT&CK technique, tactic, default criticality).
FAMILIES = (
    ("PORT_SCAN", "Balayage de ports", "T1046", "Discovery", 3),
    ("NET_SCAN", "Balayage réseau", "T1018", "Discovery", 4),
    ("DOS_FLOOD", "Déni de service volumétrique", "T1498", "Impact", 5),
    ("SSH_BRUTEFORCE", "Force brute SSH", "T1110.001", "Credential Access", 4),
    ("WEB_BRUTEFORCE", "Force brute applicative", "T1110.004", "Credential Access", 4),
    ("SLOWLORIS", "Déni de service par épuisement", "T1499.003", "Impact", 4),
    ("DNS_TUNNEL", "Tunnel DNS", "T1071.004", "Command and Control", 5),
    ("EXFILTRATION", "Exfiltration de données", "T1041", "Exfiltration", 5),
    ("C2_BEACON", "Balise de commande et contrôle", "T1071.001", "Command and Control", 5),
    ("UNKNOWN", "Anomalie non classée", "-", "-", 3),
    ("BENIGN", "Trafic normal", "-", "-", 2),
)

# Default asset inventory (cidr, name, criticality, tags).
DEFAULT_ASSETS = (
    ("192.168.1.10/32", "Serveur web", 5, ("web", "production")),
    ("192.168.1.11/32", "Base de données", 5, ("db", "production")),
    ("192.168.1.12/32", "Serveur DNS", 4, ("dns", "infra")),
    ("192.168.1.13/32", "Serveur de fichiers", 4, ("smb", "data")),
    ("192.168.1.1/32", "Passerelle", 4, ("network",)),
    ("192.168.1.0/24", "Poste de travail", 2, ("lan", "endpoint")),
    ("10.0.0.0/8", "Réseau interne", 3, ("lan",)),
    ("0.0.0.0/0", "Hôte externe", 1, ("external",)),
)
NO_ASSET = ("Inconnu", 1)

# The 52 model features in vector order.
FLOW_FEATURES = (
    "duration", "fwd_packets", "bwd_packets", "total_packets", "fwd_bytes",
    "bwd_bytes", "total_bytes", "pkts_per_sec", "bytes_per_sec",
    "fwd_bwd_pkt_ratio", "down_up_byte_ratio", "mean_pkt_size", "std_pkt_size",
    "min_pkt_size", "max_pkt_size", "mean_iat", "std_iat", "min_iat", "max_iat",
    "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count",
    "handshake_complete", "is_tcp", "is_udp", "is_icmp", "mean_payload_len",
    "payload_entropy", "empty_payload_ratio", "dport_is_system",
)
HOST_FEATURES = (
    "host_flows_10s", "host_flows_60s", "host_distinct_dst_10s",
    "host_distinct_dst_60s", "host_distinct_dport_10s",
    "host_distinct_dport_60s", "host_syn_only_rate_10s",
    "host_failed_handshake_ratio_10s", "host_bytes_out_60s",
    "host_bytes_in_60s", "host_out_in_ratio_60s", "host_new_pair_ratio_60s",
    "host_mean_flow_duration_60s", "host_beacon_regularity",
    "host_dst_repeat_max_60s",
)
DST_FEATURES = (
    "dst_flows_10s", "dst_distinct_src_10s", "dst_syn_only_rate_10s",
    "dst_failed_handshake_ratio_10s",
)
FEATURES = FLOW_FEATURES + HOST_FEATURES + DST_FEATURES

# Display labels; features not listed show their name with spaces.
FEATURE_LABELS = {
    "duration": "durée du flux (s)",
    "total_packets": "paquets échangés",
    "total_bytes": "octets échangés",
    "pkts_per_sec": "paquets/seconde",
    "bytes_per_sec": "octets/seconde",
    "fwd_bwd_pkt_ratio": "ratio paquets aller/retour",
    "down_up_byte_ratio": "ratio octets descendant/montant",
    "mean_pkt_size": "taille moyenne des paquets",
    "std_pkt_size": "variance de taille des paquets",
    "mean_iat": "intervalle moyen entre paquets",
    "std_iat": "régularité des intervalles",
    "syn_count": "nombre de SYN",
    "rst_count": "nombre de RST",
    "handshake_complete": "poignée de main TCP complétée",
    "payload_entropy": "entropie de la charge utile",
    "mean_payload_len": "taille moyenne de charge utile",
    "empty_payload_ratio": "part de paquets sans données",
    "host_flows_10s": "flux émis par l'hôte (10 s)",
    "host_flows_60s": "flux émis par l'hôte (60 s)",
    "host_distinct_dst_10s": "destinations distinctes (10 s)",
    "host_distinct_dport_10s": "ports distincts visés (10 s)",
    "host_distinct_dport_60s": "ports distincts visés (60 s)",
    "host_syn_only_rate_10s": "SYN sans réponse par seconde",
    "host_failed_handshake_ratio_10s": "part de connexions sans réponse",
    "host_bytes_out_60s": "octets sortants de l'hôte (60 s)",
    "host_out_in_ratio_60s": "ratio sortant/entrant de l'hôte",
    "host_new_pair_ratio_60s": "part de destinations jamais vues",
    "host_beacon_regularity": "régularité de type balise (beacon)",
    "host_dst_repeat_max_60s": "répétitions vers une même cible",
    "dst_flows_10s": "flux reçus par la cible (10 s)",
    "dst_distinct_src_10s": "sources distinctes vers la cible (10 s)",
    "dst_syn_only_rate_10s": "SYN/s reçus sans établissement",
    "dst_failed_handshake_ratio_10s": "part de connexions échouées sur la cible",
}

# Severity ranks and the statuses that count as open.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
OPEN_STATUSES = ("NEW", "ACK", "INVESTIGATING")

# Calibration grid.
GRID_POINTS = 2001
GRID_TOP = 0.999
SCORE_CEILING = 1.0 - 1e-9
VECTOR_CLIP = 1e9

MODEL_FORMAT = 3
PAYLOAD_SAMPLE = 256
