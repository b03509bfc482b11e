"""Protocol names, code tables and port sets."""

from __future__ import annotations

ETHERNET, SLL, SLL2 = "Ethernet", "Linux cooked v1", "Linux cooked v2"
IPV4, IPV6, ICMP, ICMPV6, TCP, UDP = "IPv4", "IPv6", "ICMP", "ICMPv6", "TCP", "UDP"
DNS, HTTP, TLS, QUIC = "DNS", "HTTP", "TLS", "QUIC"
APP_METADATA, RAW = "PCAPdroid metadata", "Raw"

LINK_TYPES = {1: "ETHERNET", 101: "RAW_IP", 113: "LINUX_SLL", 276: "LINUX_SLL2"}
ETHERTYPES = {0x0800: "IPv4", 0x86DD: "IPv6", 0x0806: "ARP", 0x8100: "802.1Q VLAN"}
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 47: "GRE", 50: "ESP", 58: "ICMPv6"}
IPV6_NEXT = {
    0: "Hop-by-hop options", 6: "TCP", 17: "UDP", 43: "Routing", 44: "Fragment", 58: "ICMPv6",
    59: "No next header", 60: "Destination options",
}
ICMP_TYPES = {0: "Echo Reply", 3: "Destination Unreachable", 5: "Redirect", 8: "Echo Request", 11: "Time Exceeded"}
ICMPV6_TYPES = {
    1: "Destination Unreachable", 2: "Packet Too Big", 3: "Time Exceeded", 128: "Echo Request", 129: "Echo Reply",
    133: "Router Solicitation", 134: "Router Advertisement", 135: "Neighbor Solicitation", 136: "Neighbor Advertisement",
}
SLL_PACKETS = {0: "Unicast (to us)", 1: "Broadcast", 2: "Multicast", 3: "Unicast (to others)", 4: "Outgoing"}
DNS_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 65: "HTTPS",
}
DNS_RCODES = {0: "NoError", 1: "FormErr", 2: "ServFail", 3: "NXDomain", 5: "Refused"}
DNS_OPCODES = {0: "Query", 1: "IQuery", 2: "Status", 4: "Notify", 5: "Update"}
TLS_RECORDS = {20: "Change Cipher Spec", 21: "Alert", 22: "Handshake", 23: "Application Data"}
TLS_VERSIONS = {
    0x0300: "SSL 3.0 (0x0300)", 0x0301: "TLS 1.0 (0x0301)", 0x0302: "TLS 1.1 (0x0302)", 0x0303: "TLS 1.2 (0x0303)",
    0x0304: "TLS 1.3 (0x0304)",
}
TLS_HANDSHAKES = {
    1: "Client Hello", 2: "Server Hello", 4: "New Session Ticket", 8: "Encrypted Extensions", 11: "Certificate",
    12: "Server Key Exchange", 13: "Certificate Request", 14: "Server Hello Done", 15: "Certificate Verify",
    16: "Client Key Exchange", 20: "Finished",
}
TLS_CIPHERS = {
    0x1301: "TLS_AES_128_GCM_SHA256", 0x1302: "TLS_AES_256_GCM_SHA384", 0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC02F: "TLS_ECDHE_RSA_AES_128_GCM_SHA256", 0xC030: "TLS_ECDHE_RSA_AES_256_GCM_SHA384",
    0xC02B: "TLS_ECDHE_ECDSA_AES_128_GCM_SHA256", 0xC02C: "TLS_ECDHE_ECDSA_AES_256_GCM_SHA384",
}
QUIC_PACKETS = {0: "Initial", 1: "0-RTT", 2: "Handshake", 3: "Retry"}
QUIC_V2 = 0x6B3343CF
HTTP_PORTS, TLS_PORTS, DNS_PORTS, QUIC_PORTS = (80, 8000, 8080, 8081), (443, 8443), (53,), (443,)
HTTP_METHODS = ("GET", "POST", "HEAD", "PUT", "DELETE", "OPTIONS", "PATCH", "CONNECT", "TRACE")
#: TCP flags from bit 0 up, as they are listed.
TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR", "NS")
TRAILER_MAGIC, TRAILER_BYTES = "01072021", 32
